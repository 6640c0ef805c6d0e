"""Mixing sources to target weights by iterative proportional fitting, in built-in functions only.

Token counts by cell (source, language, topic) are raked until their sums by
source, by language and by topic have the target shares. A document stays with
the probability that its cell was raked to, decided by a hash of its id. A cell
that would need more than all of its documents keeps all of them, and their
``weight`` says how much more each of them counts; elsewhere it is 1. So the
kept tokens, each times its document's weight, have the target shares on
average, whatever the targets.
"""

from __future__ import annotations

import json
import warnings
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, unit_hash

AXES = ("source", "lang", "topic")
TEMPERATURE = 0.7
"""Default targets: observed token shares to this power, normalised; under 1 it lifts small values."""
BUDGET = 0.6
"""Weighted tokens to keep, as a share of all."""
TOLERANCE = 1e-3
"""Raking ends when no sum is further from its target, relative to it."""
MAX_ROUNDS = 48
ROUNDS_A_TABLE = 4
FEW_VALUES = 200
"""Up to that many values of an axis have their factors in the plan, else in a table that is joined."""
SEED = 23
MISSING = "(none)"


def topic(text: Column) -> Column:
    """What kind of text it is; 'prose' for the rest and for null. The first kind that holds wins.

    Plain substrings are looked for first: a pattern runs only where a character
    that each of its matches holds occurs.
    """
    low = F.lower(text)
    has = lambda c, *parts: F.coalesce(reduce(or_, (F.contains(c, F.lit(p)) for p in parts)), F.lit(False))
    return (
        F.when(has(low, "license", "licence", "copyright", "all rights reserved"), "legal")
        .when(has(text, "@") & text.rlike(r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]+\.[A-Za-z]{2,}"), "contact")
        .when(has(text, "+") & text.rlike(r"\+\d{1,3} \(?\d"), "contact")
        .when(has(text, " | ") & text.rlike(r" \| [^\n|]* \| "), "table")
        .when(has(text, ' = "', " = '") & text.rlike(r"[A-Za-z_]\w* = [\"']") | has(text, "{\n", "}\n", ";\n"), "code")
        .otherwise("prose")
    )


def n_tokens(text: Column) -> Column:
    """Words, 1 at least, so that an empty document can be kept too."""
    return F.greatest(F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+")), F.lit(1)).cast("double")


def axis(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(MISSING))


def default_targets(cells: DataFrame, name: str) -> DataFrame:
    return cells.groupBy(name).agg(F.pow(F.sum("t"), F.lit(TEMPERATURE)).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], scratch: Scratch) -> tuple[DataFrame, float]:
    """Cells (source, lang, topic, t) with ``share``, what each has of the weighted tokens; and the largest relative deviation of a sum.

    targets: for each axis a table (axis, share). Axis values without a target
    are dropped; shares count in proportion among those that occur. Sums are
    aggregated and joined back: values are few beside cells, and no task holds
    all cells of a value. Targets that no weights of the given cells meet leave
    a deviation over TOLERANCE, and a warning that states it.
    """
    for a in AXES:
        cells = cells.join(targets[a].select(a), a, "left_semi")
    total = cells.agg(F.sum("t")).first()[0] or 1.0
    now, path = scratch.write(cells.withColumn("share", F.col("t") / total), "cells")
    present = {a: targets[a].join(now.select(a).distinct(), a, "left_semi") for a in AXES}
    sizes = {a: present[a].agg(F.sum("share"), F.count(F.lit(1))).first() for a in AXES}
    want = {a: targets[a].select(a, (F.col("share") / F.lit(sizes[a][0] or 1.0)).alias("want")) for a in AXES}
    worst = 0.0
    for n in range(1, MAX_ROUNDS + 1):
        worst = 0.0
        for a in AXES:
            factors = now.groupBy(a).agg(F.sum("share").alias("have")).join(want[a], a).select(a, (F.col("want") / F.nullif("have", F.lit(0.0))).alias("factor"))
            now, off = _scaled(now, a, factors, sizes[a][1] <= FEW_VALUES, scratch)
            worst = max(worst, off)
        if n % ROUNDS_A_TABLE == 0 or worst <= TOLERANCE:
            (now, path), old = scratch.write(now, "raked"), path
            scratch.drop(old)
        if worst <= TOLERANCE:
            break
    else:
        warnings.warn(f"raking ended {worst:.3g} off a target after {MAX_ROUNDS} rounds: the cells that occur may not allow these targets", stacklevel=2)
    return now, worst


def _scaled(cells: DataFrame, axis_: str, factors: DataFrame, few: bool, scratch: Scratch) -> tuple[DataFrame, float]:
    """Cells with shares times the factor of their axis value, and how far the worst sum was from its target."""
    off = lambda f: abs(1 / f - 1) if f else 0.0
    if few:
        found = {r[axis_]: r["factor"] for r in factors.collect()}
        factor = F.element_at(F.from_json(F.lit(json.dumps(found)), "map<string,double>"), F.col(axis_))
        return cells.withColumn("share", F.col("share") * F.coalesce(factor, F.lit(0.0))), max(map(off, found.values()), default=0.0)
    factors, _ = scratch.write(factors, "factors")
    worst = factors.agg(F.max(F.abs(1 / F.nullif("factor", F.lit(0.0)) - 1))).first()[0] or 0.0
    return cells.join(factors, axis_, "left").withColumn("share", F.col("share") * F.coalesce("factor", F.lit(0.0))).drop("factor"), worst


def mix(docs: DataFrame, scratch: Scratch, targets: dict[str, DataFrame] | None = None, budget: float = BUDGET, text: str = "text", key: str = "doc_id", seed: int = SEED, kind: Column | None = None) -> DataFrame:
    """The sampled rows of ``docs`` with topic, n_tokens, probability and weight.

    ``kind`` gives the topic, else topic() of the text does. Null sources,
    languages and topics are the value '(none)'; null and empty texts count one
    token. A row with a null key is drawn by its text. Rows of equal key are
    kept or left together where they are of one cell. An empty table gives an
    empty table; docs' columns are kept, clashing names replaced.
    """
    added = ("topic", "n_tokens", "probability", "weight")
    kind = topic(F.col(text)) if kind is None else kind
    told = docs.withColumns({"topic": kind, "n_tokens": n_tokens(F.col(text))}).drop("probability", "weight")
    cells, _ = scratch.write(told.groupBy(*[axis(a).alias(a) for a in AXES]).agg(F.sum("n_tokens").alias("t")), "tokens")
    goal = {a: scratch.write(targets[a] if targets else default_targets(cells, a), f"{a}-targets")[0] for a in AXES}
    raked, _ = rake(cells, goal, scratch)
    total = cells.agg(F.sum("t")).first()[0] or 0.0
    times = F.col("share") * F.lit(total * budget) / F.col("t")
    chance = raked.select(*[F.col(a).alias(f"__{a}") for a in AXES], F.least(times, F.lit(1.0)).alias("probability"), F.greatest(times, F.lit(1.0)).alias("weight"))
    drawn = unit_hash(seed, F.coalesce(F.col(key).cast("string"), F.col(text), F.lit("")))
    same = [axis(a) == F.col(f"__{a}") for a in AXES]
    kept = told.join(chance, same[0] & same[1] & same[2]).filter(drawn < F.col("probability"))
    return kept.select(*[c for c in docs.columns if c not in added], *added)
