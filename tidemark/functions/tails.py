"""Tails of distributions as column expressions: sums over sequences in the JVM, ending where terms vanish."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Deviations and terms from the mode within which a hypergeometric distribution's terms count: beyond, all are under 1e-30.
DEVIATIONS, TERMS = 12, 100


def _upto(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>"))


def erfc(z: Column) -> Column:
    """The complementary error function of z >= 0: by its series under 3, by its continued fraction from 3 on."""
    z = z.cast("double")
    term = F.struct(z.alias("t"), z.alias("s"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(90)), term, lambda a, k: F.struct((a["t"] * 2 * z * z / (2 * k + 1)).alias("t"), (a["s"] + a["t"] * 2 * z * z / (2 * k + 1)).alias("s")), lambda a: a["s"])
    fraction = F.aggregate(F.sequence(F.lit(60), F.lit(1)), z, lambda a, k: z + k / 2 / a)
    bell = F.exp(-z * z)
    return F.when(z < 3, 1 - 2 / math.sqrt(math.pi) * bell * series).otherwise(bell / math.sqrt(math.pi) / fraction)


def chi_square_p(x: Column, freedom: int) -> Column:
    """P(X >= x) of x >= 0, of null null: closed for even degrees, by the recurrence from one degree for odd ones."""
    if freedom == 2:
        return F.exp(-x / 2)
    x = x.cast("double")
    if freedom % 2:
        p, term, k = erfc(F.sqrt(x / 2)), F.sqrt(2 * x / math.pi) * F.exp(-x / 2), 1
    else:
        p, term, k = F.exp(-x / 2), x / 2 * F.exp(-x / 2), 2
    while k < freedom:
        p = p + term
        k += 2
        term = term * x / k
    return F.when(x.isNotNull(), F.least(p, F.lit(1.0)))


def _let(values: dict[str, Column], body) -> Column:
    """``body`` of a struct of values, each of which is computed once a row, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), body), 1)


def fisher_p(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Two-sided p of a table of two by two: the tables of equal margins that are as likely or less.

    Likelihoods are relative to the most likely table's, from which they are followed outwards by their ratios.
    """
    one, zero = F.lit(1.0), F.lit(0.0)
    a, b, c, d = (x.cast("double") for x in (a, b, c, d))

    def rise(v: Column, x: Column) -> Column:
        """From x to x + 1."""
        return (v["r"] - x) * (v["n"] - x) / ((x + 1) * (v["s"] - v["n"] + x + 1))

    def fall(v: Column, x: Column) -> Column:
        """From x to x - 1."""
        return x * (v["s"] - v["n"] + x) / ((v["r"] - x + 1) * (v["n"] - x + 1))

    def side(v: Column, here: Column, steps: Column, ratio) -> Column:
        start = F.struct(one.alias("w"), zero.alias("all"), zero.alias("hit"))

        def add(acc: Column, k: Column) -> Column:
            grown = lambda w: F.struct(w["w"].alias("w"), (acc["all"] + w["w"]).alias("all"), (acc["hit"] + F.when(w["w"] <= here, w["w"]).otherwise(zero)).alias("hit"))
            return _let({"w": acc["w"] * ratio(k)}, grown)

        return F.aggregate(_upto(F.least(steps, v["most"])), start, add)

    def total(v: Column, here: Column) -> Column:
        sides = {"up": side(v, here, v["high"] - v["mode"], lambda k: rise(v, v["mode"] + k - 1)), "down": side(v, here, v["mode"] - v["low"], lambda k: fall(v, v["mode"] - k + 1))}
        share = lambda x: (x["up"]["hit"] + x["down"]["hit"] + F.when(here >= 1, one).otherwise(zero)) / (x["up"]["all"] + x["down"]["all"] + 1)
        return F.least(one, _let(sides, share))

    def placed(v: Column) -> Column:
        above = F.aggregate(_upto(F.least(v["a"] - v["mode"], v["most"])), one, lambda w, k: w * rise(v, v["mode"] + k - 1))
        below = F.aggregate(_upto(F.least(v["mode"] - v["a"], v["most"])), one, lambda w, k: w * fall(v, v["mode"] - k + 1))
        here = F.when(F.abs(v["a"] - v["mode"]) > v["most"], zero).when(v["a"] >= v["mode"], above).otherwise(below) * (1 + 1e-7)
        return _let({"here": here}, lambda x: total(v, x["here"]))

    def centred(m: Column) -> Column:
        low, high = F.greatest(zero, m["n"] - m["s"]), F.least(m["r"], m["n"])
        mode = F.greatest(low, F.least(high, F.floor((m["r"] + 1) * (m["n"] + 1) / (m["r"] + m["s"] + 2)).cast("double")))
        both = m["r"] + m["s"]
        variance = m["n"] * m["r"] * m["s"] * (both - m["n"]) / F.nullif(both * both * F.greatest(both - 1, one), zero)
        most = F.ceil(DEVIATIONS * F.sqrt(F.coalesce(variance, zero))) + TERMS
        return _let({"a": m["a"], "r": m["r"], "s": m["s"], "n": m["n"], "low": low, "high": high, "mode": mode, "most": most.cast("double")}, placed)

    return _let({"a": a, "r": a + b, "s": c + d, "n": a + c}, centred)
