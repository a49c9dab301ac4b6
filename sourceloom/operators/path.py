"""Study paths: steps of ordered resources, filled category by category, put in order, and checked."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from . import selection as sel
from ..functions import text as tx

# The steps of a path with what they are for, and signs of a step's band in its title.
STEPS = (
    ("Foundations and Basics", "Start with beginner-friendly sources that explain the fundamentals clearly."),
    ("Core Concepts", "Build the main concepts after the fundamentals."),
    ("Applied Practice", "Apply the concepts through code, models, datasets, or practical examples."),
    ("Advanced Research", "Move to advanced papers and deeper technical material."),
    ("Deepen Understanding", "Continue studying additional relevant sources."),
)
EASY_TITLES = ("introduction", "intro ", "intro:", "intro to", "foundation", "foundations", " basics", "basic ", "basic:", "fundamental", "getting started", "overview", "primer", "first steps")
HARD_TITLES = ("advanced", "expert", "deep dive", "deep-dive", "in depth", "in-depth", "frontier", "state of the art", "state-of-the-art")
MIN_STEPS, MAX_STEPS, EACH = 3, 6, 4


def hardness() -> Column:
    """0, 1 or 2 by difficulty; where it is unknown, papers are 2 and all else 1."""
    known = F.when(F.col("difficulty") == "beginner", 0).when(F.col("difficulty") == "intermediate", 1).when(F.col("difficulty") == "advanced", 2)
    return known.when(F.col("source_type") == "research_paper", 2).otherwise(1)


def _has(title: Column, marks: tuple[str, ...]) -> Column:
    low = F.lower(title)
    return F.coalesce(*[F.when(low.contains(m), F.lit(True)) for m in marks], F.lit(False))


def title_band(title: Column) -> Column:
    return F.when(_has(title, EASY_TITLES), 0).when(_has(title, HARD_TITLES), 2).otherwise(1)


#: What a run may need candidates of: kinds of records, and what stands in for a kind that a run lacks.
_POOLS = {
    "beginner": "difficulty = 'beginner'", "easiest": "true", "intermediate": "difficulty = 'intermediate'", "not hard": "hardness <= 1", "practice": "source_type IN ('repository', 'model', 'dataset') OR has_code",
    "documentation": "source_type = 'documentation'", "advanced": "difficulty = 'advanced'", "not easy": "hardness >= 1", "any": "true",
}
_STEP_POOLS = (("beginner", "easiest"), ("intermediate", "not hard"), ("practice", "documentation"), ("advanced", "not easy"))


def _filled(each: int):
    """One run's steps from its pools (each a list of candidates in order, of bounded length)."""

    def steps(pools: dict[str, list[tuple]]) -> list[list[tuple]]:
        out, taken = [], set()
        for own, other in _STEP_POOLS:
            got = [r for r in pools.get(own) or pools.get(other, []) if r[0] not in taken][:each]
            taken.update(r[0] for r in got)
            out.append(got)
        short = max(0, MIN_STEPS - sum(map(bool, out)))
        left = [r for r in pools.get("any", []) if r[0] not in taken][: each * short]
        return [*out, *[left[i : i + each] for i in range(0, len(left), each)]]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        pools: dict[str, list[tuple]] = {}
        for r in frame.sort_values(["pool", "at"]).itertuples(index=False):
            pools.setdefault(r.pool, []).append((r.source_id, r.hardness))
        kept = [(c, got) for c, got in enumerate(steps(pools)) if got][:MAX_STEPS]
        rows = [(frame["run"].iloc[0], n, STEPS[min(c, len(STEPS) - 1)][0], place, *r) for n, (c, got) in enumerate(kept, 1) for place, r in enumerate(got, 1)]
        return pd.DataFrame(rows, columns=["run", "step", "title", "place", "source_id", "hardness"])

    return run


def greedy(ranked: DataFrame, run: str = "run_id", each: int = EACH, ordinal: str = "ordinal") -> DataFrame:
    """run, step, title, place, source_id, hardness: beginners' records, intermediate ones, practice and advanced ones, up to ``each`` that no
    step of the same run before has taken, and where a run has none of a kind the nearest others; then others until there are MIN_STEPS steps.

    Steps take ``each`` records at most, so the first few of each pool of a run suffice.  Those are found per part of a run first, and a run's
    bounded candidates meet in one function, which fills its steps in their order."""
    most = each * (len(_STEP_POOLS) + MIN_STEPS)
    rows = ranked.select(F.col(run).alias("run"), "source_id", "source_type", "difficulty", F.coalesce("has_code", F.lit(False)).alias("has_code"), F.col("score").alias("_score"), F.col(ordinal).alias("_ordinal"), hardness().alias("hardness"))
    pools = F.array(*[F.when(F.coalesce(F.expr(holds), F.lit(False)), F.lit(name)) for name, holds in _POOLS.items()])
    each_pool = rows.withColumn("pool", F.explode(F.array_compact(pools))).withColumn("_group", F.struct("run", "pool"))
    order = [F.when(F.col("pool") == "easiest", F.col("hardness")).otherwise(0), F.desc("_score"), F.asc("_ordinal")]
    few = sel.first_of_each(each_pool.select("_group", "pool", "run", "source_id", "hardness", "_score", "_ordinal"), "_group", order, most)
    numbered = few.withColumn("at", F.row_number().over(W.partitionBy("run", "pool").orderBy(*order)))
    kind = ranked.schema[run].dataType.simpleString()
    found = numbered.select("run", "pool", "at", "source_id", F.col("hardness").cast("int")).groupBy("run").applyInPandas(_filled(each), f"run {kind}, step long, title string, place long, source_id {ranked.schema['source_id'].dataType.simpleString()}, hardness int")
    return found.withColumnRenamed("run", run)


# Signs of a step's band for swapping, what belongs to a band, and the least score of a step's resource.
BAND_MARKS = {
    "advanced": ("advanced", "research", "expert", "deep dive", "in depth", "in-depth"),
    "beginner": ("foundation", "foundations", "basic", "basics", "intro", "introduction", "introductory", "fundamentals", "getting started", "primer", "overview"),
    "intermediate": ("core", "intermediate", "applied", "practice", "synthesis", "application", "techniques", "methods"),
}
BEGINNER_PLATFORMS = ("wikipedia", "wikibooks", "wikiversity", "openstax", "libretexts", "mit_ocw", "open_library", "internet_archive")
BEGINNER_TYPES = ("documentation", "course", "book", "video")
MIDDLE_PLATFORMS, MIDDLE_TYPES = ("wikipedia", "wikibooks", "openstax", "libretexts", "mit_ocw"), ("course", "book", "documentation")
LEAST_SCORE = 0.30
PLAN = "steps array<struct<title: string, objective: string, resource_source_ids: array<string>, resource_ids: array<string>, source_ids: array<string>>>"


def bands() -> Column:
    """The bands that a record fits, as a list."""
    middle = F.coalesce(F.col("difficulty") == "intermediate", F.lit(False))
    fits = {
        "advanced": middle | (F.col("difficulty") == "advanced") | (F.col("source_type") == "research_paper"),
        "beginner": middle | (F.col("difficulty") == "beginner") | F.col("platform").isin(*BEGINNER_PLATFORMS) | F.col("source_type").isin(*BEGINNER_TYPES),
        "intermediate": middle | F.col("source_type").isin(*MIDDLE_TYPES) | F.col("platform").isin(*MIDDLE_PLATFORMS),
    }
    return F.array_compact(F.array(*[F.when(F.coalesce(f, F.lit(False)), F.lit(n)) for n, f in fits.items()]))


def step_band(title: Column) -> Column:
    return F.coalesce(*[F.when(_has(title, marks), F.lit(band)) for band, marks in BAND_MARKS.items()])


def planned(plans: DataFrame, ranked: DataFrame, run: str = "run_id", text: str = "plan") -> DataFrame:
    """run, step, title, objective, place, source_id, score of the steps a model planned, as JSON, a plan a run.

    A step without a title takes its objective for one, and goes if it has neither; ids that the run's ranking lacks go; a source stays where it comes first; steps
    without sources go, and the others are numbered anew."""
    steps = plans.select(run, F.posexplode(F.from_json(text, PLAN)["steps"]).alias("_n", "s"))
    title = F.coalesce(F.nullif(tx.clean(F.col("s.title")), F.lit("")), F.nullif(tx.clean(F.col("s.objective")), F.lit("")))
    none = F.array().cast("array<string>")
    ids = F.concat(*[F.coalesce(f"s.{k}", none) for k in ("resource_source_ids", "resource_ids", "source_ids")])
    uses = steps.select(run, "_n", title.alias("title"), F.coalesce(F.nullif(tx.clean(F.col("s.objective")), F.lit("")), title).alias("objective"), F.posexplode(ids).alias("_at", "source_id")).where("title IS NOT NULL")
    first = uses.groupBy(run, "source_id").agg(F.min(F.struct("_n", "_at", "title", "objective")).alias("u")).join(ranked.select(run, "source_id", "score"), [run, "source_id"])
    w = W.partitionBy(run)
    return first.select(run, F.dense_rank().over(w.orderBy("u._n")).cast("long").alias("step"), "u.title", "u.objective", F.row_number().over(W.partitionBy(run, "u._n").orderBy("u._at")).cast("long").alias("place"), "source_id", "score")


def _assigned(frame: pd.DataFrame) -> pd.DataFrame:
    """One run's swaps: steps in their order each take the best candidate of their band that is left."""
    weak = frame[frame["step"].notna()].sort_values("step")
    left = frame[frame["step"].isna()].sort_values("at")[["new_source_id", "bands"]].values.tolist()
    out = []
    for r in weak.itertuples(index=False):
        fit = next((i for i, (_, fits) in enumerate(left) if r.band in fits), None)
        if fit is not None:
            out.append((r.run, int(r.step), r.source_id, left.pop(fit)[0]))
    return pd.DataFrame(out, columns=["run", "step", "source_id", "new_source_id"])


def swaps(path: DataFrame, ranked: DataFrame, run: str = "run_id", ordinal: str = "ordinal") -> DataFrame:
    """run, step, source_id, new_source_id: each step whose weakest resource scores under LEAST_SCORE and whose title says its band gets for it the best
    record of the run that no step uses, is good enough and fits the band; a record that one step has got is no other step's, and what it replaced is free.

    A run needs no more candidates of a band than it has weak steps, so the best of each part of a run are taken first, and a run's few rows meet in one function."""
    weakest = path.groupBy(run, "step").agg(F.min(F.struct("score", "place", "source_id", "title")).alias("w"))
    weak = weakest.where(F.col("w.score") < LEAST_SCORE).select(F.col(run).alias("run"), "step", "w.source_id", step_band(F.col("w.title")).alias("band")).where("band IS NOT NULL")
    most = weak.groupBy("run").count().agg(F.max("count")).first()[0] or 0
    free = ranked.where(F.col("score") >= LEAST_SCORE).join(path.select(run, "source_id"), [run, "source_id"], "left_anti")
    each = free.select(F.col(run).alias("run"), F.col("source_id").alias("new_source_id"), "score", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.col(ordinal).alias("ordinal"), bands().alias("bands"))
    order = [F.desc("score"), F.desc("confidence"), F.asc("ordinal")]
    pooled = each.withColumn("group", F.explode("bands")).withColumn("group", F.struct("run", "group"))
    few = sel.first_of_each(pooled, "group", order, most).drop("group").distinct()
    best = few.withColumn("at", F.row_number().over(W.partitionBy("run").orderBy(*order)))
    kinds = {f: path.schema[f].dataType.simpleString() for f in (run, "source_id")}
    rows = weak.select("run", "step", "source_id", "band", F.lit(None).cast("int").alias("at"), F.lit(None).cast(kinds["source_id"]).alias("new_source_id"), F.lit(None).cast("array<string>").alias("bands"))
    rows = rows.unionByName(best.select("run", "at", "new_source_id", "bands"), allowMissingColumns=True)
    found = rows.groupBy("run").applyInPandas(_assigned, f"run {kinds[run]}, step long, source_id {kinds['source_id']}, new_source_id {kinds['source_id']}")
    return found.withColumnRenamed("run", run)


def swapped(path: DataFrame, ranked: DataFrame, run: str = "run_id") -> DataFrame:
    """A planned path with its weak resources replaced; ``swapped`` tells which."""
    new = swaps(path, ranked, run).join(ranked.select(run, F.col("source_id").alias("new_source_id"), F.col("score").alias("_score")), [run, "new_source_id"])
    both = path.join(new, [run, "step", "source_id"], "left")
    return both.select(run, "step", "title", "place", F.coalesce("new_source_id", "source_id").alias("source_id"), F.coalesce("_score", "score").alias("score"), F.col("new_source_id").isNotNull().alias("swapped"))


def aligned(path: DataFrame, run: str = "run_id") -> DataFrame:
    """A path's steps in the order of their titles' bands, then of their mean hardness, and each step's resources from easy to hard."""
    means = path.groupBy(run, "step").agg(F.avg("hardness").alias("mean"), F.first("title").alias("title"))
    order = W.partitionBy(run).orderBy(title_band(F.col("title")), "mean", "step")
    numbers = means.withColumn("new", F.row_number().over(order).cast("long")).select(run, "step", "new")
    placed = path.join(numbers, [run, "step"]).withColumn("place", F.row_number().over(W.partitionBy(run, "step").orderBy("hardness", "place")).cast("long"))
    return placed.drop("step").withColumnRenamed("new", "step").select(run, "step", "title", "place", "source_id", "hardness")


def with_sources(path: DataFrame, sources: DataFrame) -> DataFrame:
    """A path's resource ids joined to their records; ids that no record has go."""
    return path.join(sources, "source_id")


def out_of_band(path: DataFrame) -> DataFrame:
    """path with ``fits``: whether a resource's hardness is within one of its step's band."""
    return path.withColumn("fits", F.abs(F.col("hardness") - title_band(F.col("title"))) <= 1)


def annotated(title: Column, step: Column, level: str) -> Column:
    """A step's objective, with the level asked for in the first step."""
    objective = F.lit("")
    for name, text in STEPS:
        objective = F.when(title == name, F.lit(text)).otherwise(objective)
    return F.when(step == 1, F.concat(objective, F.lit(f" Level: {level}."))).otherwise(objective)


def misordered(steps_: DataFrame, run: str = "run_id") -> DataFrame:
    """Runs in which a step's mean difficulty falls by more than 0.25 from the step before."""
    mean = steps_.groupBy(run, "step").agg(F.avg("hardness").alias("mean"))
    back = F.lag("mean").over(W.partitionBy(run).orderBy("step"))
    return mean.withColumn("drop", F.coalesce(back > F.col("mean") + 0.25, F.lit(False))).groupBy(run).agg(F.bool_or("drop").alias("misordered"), F.count("*").alias("steps"))


def reordered(steps_: DataFrame, run: str = "run_id") -> DataFrame:
    """Steps (run, step, title) by the bands of their titles where every title has one and they are out of order; else as they are."""
    one = steps_.withColumns({"band": title_band(F.col("title")), "_sign": _has(F.col("title"), (*EASY_TITLES, *HARD_TITLES))})
    one = one.withColumn("_fell", F.coalesce(F.lag("band").over(W.partitionBy(run).orderBy("step")) > F.col("band"), F.lit(False)))
    state = one.groupBy(run).agg((F.bool_and("_sign") & F.bool_or("_fell")).alias("_move"))
    order = W.partitionBy(run).orderBy(F.when(F.col("_move"), F.col("band")).otherwise(0), "step")
    return one.join(state, run).withColumn("place", F.row_number().over(order).cast("long")).select(run, "step", "place")


def padded_or_cut(reason: Column, text: Column) -> Column:
    """Whether a path is cut off (its JSON has more opened than closed) or was padded (a reason says so)."""
    opened = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    cut = (opened("{") != opened("}")) | (opened("[") != opened("]"))
    return F.when(cut, "cut").when(F.lower(reason).contains("selected to ensure"), "padded").otherwise("whole")
