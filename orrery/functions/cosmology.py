"""Background distances by integrals, a fitted transfer function, and lookups of them as columns.

Distances are integrals over redshift of matter, radiation, curvature and dark energy. The transfer function is the fit
of Eisenstein and Hu (1998), scaled to sigma 8 by a top-hat integral: a published stand-in for a Boltzmann solver, which isn't installed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .presets import cosmology

LIGHT = 299792.458


class Cosmology:
    """Distances are in Mpc, wave numbers in h/Mpc."""

    def __init__(self, name: str = "desi-dr2-planck-act-mnufree", use_w: bool = False, **changes):
        self.name, self.params = name, cosmology(name, **changes)
        p = self.params
        h2 = p["h"] ** 2
        self.omega_nu = p.get("mnu", 0.0) / 93.14 / h2
        self.omega_b, self.omega_c = p["ombh2"] / h2, p["omch2"] / h2
        self.omega_m = self.omega_b + self.omega_c + self.omega_nu
        photons = 2.47282e-5 * (p["TCMB"] / 2.7255) ** 4 / h2
        massless = p.get("nnu", 3.044) - (p.get("numnu", 0) if p.get("mnu", 0) > 0 else 0)
        self.omega_r = photons * (1 + 0.2271 * max(massless, 0.0))
        self.omega_k = p.get("omegak", 0.0)
        self.omega_l = 1 - self.omega_m - self.omega_r - self.omega_k
        self.w0, self.wa = (p.get("w0", -1.0), p.get("wa", 0.0)) if use_w else (-1.0, 0.0)
        self.z_table = np.logspace(-5, np.log10(1100), 10_000)
        grid = np.concatenate([[0.0], self.z_table])
        middle = 0.5 * (grid[1:] + grid[:-1])
        ends, half = 1 / self.expansion(grid), 1 / self.expansion(middle)
        self.chi_table = np.cumsum(np.diff(grid) * (ends[1:] + ends[:-1] + 4 * half) / 6) * LIGHT / (100 * p["h"])

    def expansion(self, z: np.ndarray) -> np.ndarray:
        """H(z) / H(0)."""
        a1 = 1 + z
        dark = a1 ** (3 * (1 + self.w0 + self.wa)) * np.exp(-3 * self.wa * z / a1)
        return np.sqrt(self.omega_m * a1**3 + self.omega_r * a1**4 + self.omega_k * a1**2 + self.omega_l * dark)

    def z2chi(self, z):
        """Comoving distance; the ends of the table hold beyond it."""
        return np.interp(z, self.z_table, self.chi_table)

    def chi2z(self, chi):
        return np.interp(chi, self.chi_table, self.z_table)

    def chi_interpolator(self, zmax: float = 1100.0, n: int = 1000):
        """z to distance, linear between n equal steps of log a up to zmax; the last pieces go on beyond."""
        z = np.sort(1 / np.logspace(-np.log10(1 + zmax), 0, n) - 1)
        z[0] = 0.0
        chi = self.z2chi(z)

        def chiofz(at):
            at = np.asarray(at, dtype=float)
            i = np.clip(np.searchsorted(z, at, side="right") - 1, 0, n - 2)
            return chi[i] + (at - z[i]) * (chi[i + 1] - chi[i]) / (z[i + 1] - z[i])

        return chiofz

    def transfer(self, k: np.ndarray) -> np.ndarray:
        """The fit without wiggles, 1 at small k."""
        p, t = self.params, self.params["TCMB"] / 2.7
        om, fb = self.omega_m * p["h"] ** 2, self.omega_b / self.omega_m
        s = 44.5 * np.log(9.83 / om) / np.sqrt(1 + 10 * p["ombh2"] ** 0.75)
        alpha = 1 - 0.328 * np.log(431 * om) * fb + 0.38 * np.log(22.3 * om) * fb**2
        gamma = self.omega_m * p["h"] * (alpha + (1 - alpha) / (1 + (0.43 * k * p["h"] * s) ** 4))
        q = k * t**2 / gamma
        low = np.log(2 * np.e + 1.8 * q)
        return low / (low + (14.2 + 731 / (1 + 62.5 * q)) * q**2)

    def power(self, k: np.ndarray) -> np.ndarray:
        """Linear P(k) today; its amplitude is sigma 8 where that is given, else follows from As."""
        shape = k ** self.params["ns"] * self.transfer(k) ** 2
        if self.params.get("sigma8"):
            return shape * (self.params["sigma8"] / self._sigma8(lambda x: x ** self.params["ns"] * self.transfer(x) ** 2)) ** 2
        p = self.params
        pivot = p["k0phys"] / p["h"]
        om = self.omega_m
        growth = 2.5 * om / (om ** (4 / 7) - self.omega_l + (1 + om / 2) * (1 + self.omega_l / 70))
        curvature = p["As"] * (k / pivot) ** (p["ns"] - 1) * 2 * np.pi**2 / k**3
        return curvature * (0.4 * growth / om * (k * LIGHT / 100) ** 2 * self.transfer(k)) ** 2

    def _sigma8(self, power) -> float:
        k = np.logspace(-4, 2, 4000)
        x = 8 * k
        top = 3 * (np.sin(x) - x * np.cos(x)) / x**3
        y = power(k) * top**2 * k**3 / (2 * np.pi**2)
        steps = np.diff(np.log(k))
        return float(np.sqrt(np.sum(0.5 * (y[1:] + y[:-1]) * steps)))

    def sigma8(self) -> float:
        return self._sigma8(self.power)

    def table(self, n: int = 400) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(k, P, T): T(k) = sqrt(P / (As (k / pivot)^ns))."""
        p = self.params
        k = np.logspace(np.log10(5e-5), np.log10(20), n)
        power = self.power(k)
        return k, power, np.sqrt(power / (p["As"] * (k * p["h"] / p["k0phys"]) ** p["ns"]))

    def summary(self) -> str:
        p = self.params
        rows = [
            ("H0 [km/s/Mpc]:", f"{100 * p['h']:.4f}"), ("h (H0/100):", f"{p['h']:.4f}"), ("Omega_b h^2 (ombh2):", f"{p['ombh2']:.5f}"), ("Omega_c h^2 (omch2):", f"{p['omch2']:.5f}"), ("Omega_k (omk):", f"{self.omega_k:.4f}"),
            ("mnu [eV]:", f"{p.get('mnu', 0.0):.4f}"), ("N_eff (standard_neff):", f"{p.get('nnu', 3.044):.4f}"), ("A_s (scalar amp):", f"{p['As']:.4e}"), ("n_s (scalar index):", f"{p['ns']:.4f}"),
            ("Omega_matter_total (z=0):", f"{self.omega_m:.5f}"), ("Omega_radiation_total (z=0):", f"{self.omega_r:.5e}"), ("Omega_DE (Lambda, z=0):", f"{self.omega_l:.5f}"), ("sigma_8 (Final, for P(k)):", f"{self.sigma8():.4f}"),
        ]
        return "\n".join(f"{a:<26} {b}" for a, b in rows)


def interpolated(column: Column, xs: np.ndarray, ys: np.ndarray) -> Column:
    """Linear interpolation in a table of fixed size; the ends hold beyond it."""
    xs, ys = np.asarray(xs, dtype=float), np.asarray(ys, dtype=float)

    @F.pandas_udf("double")
    def look(v: pd.Series) -> pd.Series:
        return pd.Series(np.where(v.isna(), np.nan, np.interp(v.fillna(0.0), xs, ys)), index=v.index)

    return look(column.cast("double"))


def applied(column: Column, function) -> Column:
    """A numpy function of one array, as a column; null stays null."""

    @F.pandas_udf("double")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series(np.where(v.isna(), np.nan, function(v.fillna(0.0).to_numpy())), index=v.index)

    return F.nanvl(run(column.cast("double")), F.lit(None).cast("double"))


def chi_of_z(z: Column, cosmo: Cosmology) -> Column:
    return interpolated(z, cosmo.z_table, cosmo.chi_table)


def z_of_chi(chi: Column, cosmo: Cosmology) -> Column:
    return interpolated(chi, cosmo.chi_table, cosmo.z_table)


def outer_redshift(cosmo: Cosmology, box: float) -> float:
    """The redshift at 0.98 of a box's side, in Mpc/h."""
    return float(cosmo.chi2z(0.98 * box / cosmo.params["h"]))
