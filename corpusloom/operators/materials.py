"""Tolerance factors of ABX3 compounds from ionic radii."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ionic radii (coordination 12 at site A, 6 at sites B and X).
A_RADII = {"Cs": 1.88, "Rb": 1.72, "K": 1.64, "Na": 1.39, "MA": 2.17, "FA": 2.53, "EA": 2.74, "GA": 2.78}
B_RADII = {
    "Pb": 1.19, "Sn": 1.18, "Ge": 0.73, "Mn": 0.83, "Cu": 0.73, "Zn": 0.74, "Mg": 0.72, "Ca": 1.00, "Sr": 1.18, "Ba": 1.35, "Ti": 0.605, "Zr": 0.72,
    "Bi": 1.03, "Sb": 0.76, "In": 0.80, "Cd": 0.95, "Fe": 0.78, "Ni": 0.69, "Co": 0.745, "Pd": 0.86, "Pt": 0.80, "Ag": 1.15,
}
X_RADII = {"F": 1.33, "Cl": 1.81, "Br": 1.96, "I": 2.20, "O": 1.40, "S": 1.84, "Se": 1.98}

#: Of the ion of three charges, which a formula can't tell from three atoms. Fixed value.
FE3_RADIUS = 0.645


def _table(radii: dict[str, float]) -> Column:
    return F.create_map(*(F.lit(x) for pair in radii.items() for x in pair))


def ionic_radius(symbol: Column, number: Column) -> Column:
    """The radius of an ion for the coordination number nearest to the one asked for; null for
    an unknown one."""
    held: dict[str, list[tuple[int, float]]] = {}
    for cn, radii in ((12, A_RADII), (6, B_RADII | {"Fe3": FE3_RADIUS}), (6, X_RADII)):
        for ion, r in radii.items():
            held.setdefault(ion, []).append((cn, r))
    table = F.create_map(*(x for ion, rows in held.items() for x in (F.lit(ion), F.array(*(F.struct(F.lit(cn).alias("cn"), F.lit(float(r)).alias("r")) for cn, r in rows)))))
    near = F.transform(F.element_at(table, symbol), lambda e: F.struct(F.abs(e["cn"] - number).alias("far"), e["cn"].alias("cn"), e["r"].alias("r")))
    return F.array_min(near)["r"]


_TOKEN = r"MA|FA|EA|GA|AC(?![a-z])|[A-Z][a-z]?|[(\[{]|[)\]}]|\d+\.?\d*|\.\d+"
_PART = "struct<symbol:string,amount:double>"


def _tokens(formula: Column) -> Column:
    return F.regexp_extract_all(formula, F.lit(_TOKEN), F.lit(0))


def species(formula: Column) -> Column:
    """array<struct<symbol, amount>> of a formula, in order; organic cations are symbols of their
    own, and a number behind a bracket multiplies all that it holds, at any depth.

    A fold over the tokens from the last to the first: a number waits for what stands before
    it; a closing bracket lays its number, times that of the bracket around it, on a stack, and
    an opening one takes it off; a symbol is told with its number times the top of the stack."""
    start = F.struct(F.array(F.lit(1.0)).alias("stack"), F.lit(None).cast("double").alias("number"), F.array().cast(f"array<{_PART}>").alias("out"))

    def step(s: Column, token: Column) -> Column:
        top, by = F.element_at(s["stack"], 1), F.coalesce(s["number"], F.lit(1.0))
        none = F.lit(None).cast("double")
        closed = F.struct(F.concat(F.array(top * by), s["stack"]).alias("stack"), none.alias("number"), s["out"].alias("out"))
        opened = F.struct(F.when(F.size(s["stack"]) > 1, F.slice(s["stack"], F.lit(2), F.size(s["stack"]))).otherwise(s["stack"]).alias("stack"), none.alias("number"), s["out"].alias("out"))
        number = F.struct(s["stack"].alias("stack"), token.try_cast("double").alias("number"), s["out"].alias("out"))
        told = F.struct(s["stack"].alias("stack"), none.alias("number"), F.concat(F.array(F.struct(token.alias("symbol"), (by * top).alias("amount"))), s["out"]).alias("out"))
        return F.when(token.isin(")", "]", "}"), closed).when(token.isin("(", "[", "{"), opened).when(token.rlike("^[0-9.]"), number).otherwise(told)

    return F.aggregate(F.reverse(_tokens(formula)), start, step, lambda s: s["out"])


def well_formed(formula: Column) -> Column:
    """Nothing but symbols, numbers and brackets that close."""
    depth = F.aggregate(
        _tokens(formula), F.lit(0),
        lambda d, t: F.when(d < 0, d).otherwise(d + F.when(t.isin("(", "[", "{"), 1).when(t.isin(")", "]", "}"), -1).otherwise(0)),
    )
    return (F.array_join(_tokens(formula), "") == F.regexp_replace(formula, r"\s", "")) & (depth == 0)


#: The radius of a species that no table has. Fixed value.
UNKNOWN_RADIUS = 1.5


def _scanned(formula: Column, radii: dict[str, float], amount: Column | None) -> Column:
    """Symbols of a table that stand anywhere in a text that is no formula; an amount is the sum
    of the numbers behind the symbol, 1 for each place without."""
    behind = lambda sym: F.transform(F.regexp_extract_all(formula, F.concat(F.lit("(?:"), sym, F.lit(r")(?![a-z])(\d*\.?\d*)")), F.lit(1)), lambda n: F.coalesce(F.nullif(n, F.lit("")).try_cast("double"), F.lit(1.0)))
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    each = F.transform(F.array(*map(F.lit, radii)), lambda sym: F.struct(sym.alias("symbol"), (amount if amount is not None else add(behind(sym))).alias("amount"), F.size(behind(sym)).alias("n")))
    return F.transform(F.filter(each, lambda e: e["n"] > 0), lambda e: F.struct(e["symbol"].alias("symbol"), e["amount"].alias("amount")))


def sites(formula: Column) -> Column:
    """struct<a, b, x, scanned>: the species of each site. Symbols that no site has, such as AC,
    count at site A. A text that is no formula is scanned for symbols: those of A with their
    numbers, those of B with 1, the first of X with 3, or iodine if there is none."""
    parts, whole = species(formula), well_formed(formula)
    of = lambda radii: F.filter(parts, lambda p: p["symbol"].isin(*radii))
    a = F.filter(parts, lambda p: ~p["symbol"].isin(*B_RADII, *X_RADII))
    x = F.slice(_scanned(formula, X_RADII, F.lit(3.0)), 1, 1)
    x = F.when(F.size(x) > 0, x).otherwise(F.array(F.struct(F.lit("I").alias("symbol"), F.lit(3.0).alias("amount"))))
    pick = lambda one, other: F.when(whole, one).otherwise(other)
    return F.when(formula.isNotNull(), F.struct(pick(a, _scanned(formula, A_RADII | {"AC": 0.0}, None)).alias("a"), pick(of(B_RADII), _scanned(formula, B_RADII, F.lit(1.0))).alias("b"), pick(of(X_RADII), x).alias("x"), (~whole).alias("scanned")))


def _radius(parts: Column, radii: dict[str, float]) -> Column:
    """Mean radius of a site's species, weighted by amount; null without any."""
    known = _table(radii)
    add = lambda f: F.aggregate(parts, F.lit(0.0), lambda s, p: s + f(p))
    return add(lambda p: p["amount"] * F.coalesce(F.try_element_at(known, p["symbol"]), F.lit(UNKNOWN_RADIUS))) / F.nullif(add(lambda p: p["amount"]), F.lit(0.0))


def tolerance(rows: DataFrame, formula: str = "formula") -> DataFrame:
    """rows with r_a, r_b, r_x, t, mu, crystal and stable; null where a site has no species. A
    formula is parsed once, however many rows have it."""
    made = rows.select(formula).distinct().withColumn("_s", sites(F.col(formula)))
    made = made.select(formula, *(_radius(F.col(f"_s.{site}"), radii).alias(f"r_{site}") for site, radii in (("a", A_RADII), ("b", B_RADII), ("x", X_RADII))))
    out = rows.join(made, rows[formula].eqNullSafe(made[formula])).drop(made[formula])
    out = out.withColumns({"t": (F.col("r_a") + F.col("r_x")) / (math.sqrt(2) * (F.col("r_b") + F.col("r_x"))), "mu": F.col("r_b") / F.col("r_x")})
    t = F.col("t")
    crystal = F.when(t > 1.0, "hexagonal").when(t >= 0.9, "cubic").when(t >= 0.8, "tetragonal/orthorhombic").when(t >= 0.7, "orthorhombic or none").when(t.isNotNull(), "none")
    return out.withColumns({"crystal": crystal, "stable": t.between(0.71, 1.0) & F.col("mu").between(0.41, 0.90)})
