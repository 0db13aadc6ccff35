"""Exponential-family pieces for IRLS: inverse link, dμ/dη, variance, deviance (numpy)."""

from __future__ import annotations

import numpy as np

EPS = 1e-10


class Family:
    name = ""
    link = ""
    scale_known = True

    def linkinv(self, eta):
        raise NotImplementedError

    def mu_eta(self, eta):
        raise NotImplementedError

    def variance(self, mu):
        raise NotImplementedError

    def deviance(self, y, mu, w):
        raise NotImplementedError

    def start_eta(self, y):
        raise NotImplementedError


class Poisson(Family):
    name, link = "poisson", "log"

    def linkinv(self, eta):
        return np.exp(np.clip(eta, -700, 700))

    def mu_eta(self, eta):
        return np.maximum(np.exp(np.clip(eta, -700, 700)), EPS)

    def variance(self, mu):
        return np.maximum(mu, EPS)

    def deviance(self, y, mu, w):
        mu = np.maximum(mu, EPS)
        t = np.where(y > 0, y * np.log(np.where(y > 0, y, 1.0) / mu), 0.0)
        return float(np.sum(2.0 * w * (t - (y - mu))))

    def start_eta(self, y):
        return np.log(y + 0.1)


class Binomial(Family):
    name = "binomial"

    def __init__(self, link: str = "logit"):
        if link not in ("logit", "cloglog"):
            raise ValueError(f"no such binomial link: {link}")
        self.link = link

    def linkinv(self, eta):
        if self.link == "logit":
            return 1.0 / (1.0 + np.exp(-np.clip(eta, -700, 700)))
        return -np.expm1(-np.exp(np.clip(eta, -700, 30)))  # cloglog

    def mu_eta(self, eta):
        if self.link == "logit":
            m = self.linkinv(eta)
            return np.maximum(m * (1.0 - m), EPS)
        e = np.clip(eta, -700, 30)
        return np.maximum(np.exp(e - np.exp(e)), EPS)

    def variance(self, mu):
        mu = np.clip(mu, EPS, 1.0 - EPS)
        return mu * (1.0 - mu)

    def deviance(self, y, mu, w):
        mu = np.clip(mu, EPS, 1.0 - EPS)
        return float(-2.0 * np.sum(w * (y * np.log(mu) + (1.0 - y) * np.log(1.0 - mu))))

    def start_eta(self, y):
        mu = (y + 0.5) / 2.0
        if self.link == "logit":
            return np.log(mu / (1.0 - mu))
        return np.log(-np.log(1.0 - mu))


class NegBin(Poisson):
    """Negative binomial with known θ (variance μ + μ²/θ), log link."""
    name = "negbin"

    def __init__(self, theta: float):
        self.theta = float(theta)

    def variance(self, mu):
        return np.maximum(mu + mu * mu / self.theta, EPS)

    def deviance(self, y, mu, w):
        th = self.theta
        mu = np.maximum(mu, EPS)
        t1 = np.where(y > 0, y * np.log(np.where(y > 0, y, 1.0) / mu), 0.0)
        t2 = (y + th) * np.log((y + th) / (mu + th))
        return float(np.sum(2.0 * w * (t1 - t2)))


def family(name: str, link: str | None = None, theta: float | None = None) -> Family:
    if name == "poisson":
        return Poisson()
    if name == "binomial":
        return Binomial(link or "logit")
    if name == "negbin":
        if theta is None:
            raise ValueError("the negative binomial needs theta")
        return NegBin(theta)
    raise ValueError(name)
