"""Mixing sources to target weights by entropy balancing; DataFrame functions only.

Each source gets a share of ``budget`` times all words in proportion to its weight, at most ``cap`` times its own words;
what a capped source cannot take is dealt again among the others. A document of size ``x`` in source ``s`` is taken at
rate ``r = cap / (1 + exp(-lam_s * x / mean_s))``: the maximiser of the (bounded) entropy under the one constraint that
the source's expected words meet its target, an exponential tilt of the even rate ``cap / 2``. The dual is convex and
separable by source; all sources take their Newton steps together, one distributed aggregation a step over the counts by
(source, size), each step kept inside a bracket that shrinks, so it cannot diverge; they end when all sources are solved.

Rounding: of a document's ``cap`` possible copies, copy ``k`` (from 0) is taken if ``v = k + u - r`` is at most its source's threshold,
where ``u`` in [0, 1) is a hash of the document: at threshold 0 that is ``floor(r)`` copies or one more, so often that ``r`` is expected.
The threshold, near zero, is set so that the source's words meet the target: by counting words over ``BINS`` bins of ``v`` and sorting
the one bin in which the target lies. That can miss by half a long document, so ``FIXES`` further passes set another threshold for
the documents no longer than what is missed.
All that leads from a document to its copies is thus one row for each source; no decisions about documents are stored or joined,
and no group of documents meets in one task, but for one bin of one source, a ``BINS``th of it.

Defined results: a null text has size 0; nulls in the source form a source of their own, last; documents of size 0 take 0
words and no copies; rows that repeat both id and text get the same number of copies; an empty table gives an empty
result; other columns are ignored by ``mix`` and passed through by ``repeat_rows``.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize

BINS = 8192
STEPS = 40
FIXES = 4


def word_count(text: Column) -> Column:
    """Number of words; runs of other characters separated by ASCII white space."""
    # a word starts at each non-space after a space: counted by what replacing words with one mark leaves
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^ \t-\r]+", "x")
    return F.length(F.translate(marks, " \t\n\x0b\x0c\r", "")).cast("long")


def source_targets(sizes: DataFrame, weights: list[float], budget: float, cap: float) -> DataFrame:
    """``sizes``: source, source_size. Adds target. Water filling: sources in order of the ratio at which they are capped."""
    ordered = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("_w", F.element_at(cycle, ((F.row_number().over(ordered) - 1) % len(weights) + 1).cast("int")))
    everything = Window.partitionBy(F.lit(0))
    before = everything.orderBy((F.lit(cap) * F.col("source_size") / F.col("_w")), F.encode("source", "utf-8")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    filled = (
        ranked.withColumn("_total", F.sum("source_size").over(everything) * F.lit(budget))
        .withColumn("_spent", F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0.0)))
        .withColumn("_weights_left", F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
        .withColumn("_level", (F.col("_total") - F.col("_spent")) / F.col("_weights_left"))
        .withColumn("_capped", F.col("_level") * F.col("_w") >= F.col("source_size") * cap)
    )
    # the first source that is not capped fixes the level for itself and all after it
    level = F.min(F.when(~F.col("_capped"), F.struct(F.col("source_size") * cap / F.col("_w"), F.col("_level")))).over(everything)
    return filled.withColumn("_at", level).select(
        "source",
        "source_size",
        F.when(F.col("_at").isNull() | F.col("_capped"), F.col("source_size") * cap)
        .otherwise(F.least(F.col("_at")["_level"] * F.col("_w"), F.col("source_size") * cap))
        .cast("double")
        .alias("target"),
    )


def _rate(cap: float) -> Column:
    tilt = F.col("lam") * F.col("size") / F.col("mean_size")
    return F.when(F.col("full"), F.lit(cap)).otherwise(F.lit(cap) / (1 + F.exp(-tilt)))


def solve_dual(classes: DataFrame, targets: DataFrame, cap: float, steps: int = STEPS) -> DataFrame:
    """Newton steps on all sources' duals. ``classes``: name, size, n. Adds lam, full and mean_size to the targets."""
    means = classes.groupBy("name").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean_size"))
    state = targets.join(means, "name").select(
        "name", "source_size", "target", F.greatest("mean_size", F.lit(1e-9)).alias("mean_size"),
        (F.col("target") >= F.col("source_size") * cap).alias("full"),
        F.lit(0.0).alias("lam"), F.lit(-64.0).alias("lo"), F.lit(64.0).alias("hi"), F.lit(False).alias("solved"),
    )
    state = materialize(state, "mix-dual")
    for _ in range(steps):
        rate = _rate(cap)
        words = F.col("n") * F.col("size") * rate
        slope = words * (F.lit(cap) - rate) / cap * F.col("size") / F.col("mean_size")
        step = classes.join(state, "name").groupBy(*state.columns).agg(F.sum(words).alias("words"), F.sum(slope).alias("slope"))
        under = F.col("words") < F.col("target")
        lo, hi = F.when(under, F.col("lam")).otherwise(F.col("lo")), F.when(under, F.col("hi")).otherwise(F.col("lam"))
        # a solved source stays where it is: its step is rounding error, which may point out of the bracket
        solved = F.col("full") | F.col("solved") | (F.abs(F.col("target") - F.col("words")) <= 1e-11 * F.col("target"))
        step = step.withColumns({"lo": lo, "hi": hi, "solved": solved | (hi - lo < 1e-13)})
        newton = F.col("lam") + (F.col("target") - F.col("words")) / F.col("slope")
        inside = (F.col("slope") > 0) & (newton > F.col("lo")) & (newton < F.col("hi"))
        new = F.when(F.col("full"), 0.0).when(F.col("solved"), F.col("lam")).when(inside, newton).otherwise((F.col("lo") + F.col("hi")) / 2)
        state = materialize(step.withColumn("lam", new).select(*state.columns), "mix-dual")
        if state.where("not solved").isEmpty():
            break
    # sums in another order differ in their last digits; rates do not, once those digits are gone
    return state.withColumn("lam", F.round("lam", 9))


def _place(cap: float) -> Column:
    """v of the first copy of a document with columns u, size and its source's lam, mean_size and full."""
    return F.col("u") - F.round(_rate(cap), 9)


def _choose(rows: DataFrame, state: DataFrame, cap: int, first: bool) -> DataFrame:
    """One more step for each source of ``state``: among the possible copies (``rows``: name, size, v) no longer than what it misses,
    those with v up to the step's tau are to have as many words as are chosen of them now and are missed besides."""
    limit = F.lit(1e300) if first else F.abs("miss").cast("double")
    fit = rows.join(state.select("name", "miss", "full", "steps"), "name").where(F.col("size") <= limit)
    fit = fit.withColumns({"bin": F.floor((F.col("v") + cap) * (BINS / (2 * cap))).cast("int"), "chosen": F.when(F.col("v") <= _tau(), F.col("size")).otherwise(0)})
    bins = fit.groupBy("name", "bin").agg(F.sum("size").alias("words"), F.sum("chosen").alias("now"), F.first("miss").alias("miss"))
    of_source = Window.partitionBy("name")  # BINS rows at most
    bins = bins.withColumns({"upto": F.sum("words").over(of_source.orderBy("bin")), "need": F.col("miss") + F.sum("now").over(of_source), "total": F.sum("words").over(of_source)})
    here = (F.col("upto") - F.col("words") <= F.col("need")) & (F.col("need") < F.col("upto"))
    edges = bins.groupBy("name").agg(
        F.first("need").alias("need"), F.first("total").alias("total"), F.max(F.when(here, F.col("bin"))).alias("bin"),
        F.max(F.when(here, F.col("upto") - F.col("words"))).alias("before"),
    )
    edges = materialize(edges, "mix-edges")
    inside = fit.select("name", "bin", "size", "v").join(edges, ["name", "bin"])
    run = F.col("before") + F.sum("size").over(Window.partitionBy("name").orderBy("v"))  # a range: equal v come together
    equal = F.sum("size").over(Window.partitionBy("name", "v"))
    marked = inside.withColumns({"run": run, "equal": equal}).where("run - equal / 2 <= need")
    last = marked.groupBy("name").agg(F.max("v").alias("last"), F.max("run").alias("got"))
    none, every = F.col("need") <= 0, F.col("need") >= F.col("total")
    below = (F.col("bin") * (2 * cap / BINS) - cap - 1e-12).cast("double")
    step = edges.join(last, "name", "left").select(
        "name", F.when(none, -2.0 * cap).when(every, 2.0 * cap).otherwise(F.coalesce("last", below)).alias("tau"),
        (F.col("need") - F.when(none, 0).when(every, F.col("total")).otherwise(F.coalesce("got", "before"))).alias("left"),
    )
    both = state.join(step, "name", "left")
    added = F.concat("steps", F.array(F.struct(limit.alias("limit"), "tau")))
    known = F.col("tau").isNotNull()
    return both.withColumns({"steps": F.when(known, added).otherwise(F.col("steps")), "miss": F.when(known, F.col("left")).otherwise(F.col("miss"))}).drop("tau", "left")


def _tau() -> Column:
    """The threshold of a document with columns size and its source's ``steps`` (limit, tau): of the last step that it fits."""
    own = F.filter("steps", lambda s: F.col("size") <= s["limit"])
    return F.coalesce(F.get(own, F.size(own) - 1)["tau"], F.lit(-1e300))


def mixture(narrow: DataFrame, weights: tuple[float, ...], budget: float, cap: int) -> DataFrame:
    """``narrow``: name, source, size, u. One row a source: name, source_size, target, lam, mean_size, full, steps."""
    classes = materialize(narrow.groupBy("name", "source", "size").agg(F.count("*").alias("n")), "mix-classes")
    sizes = classes.groupBy("name", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    sizes = materialize(sizes, "mix-sources")
    targets = source_targets(sizes.select("source", "source_size"), list(weights), budget, cap)
    targets = targets.select(_name(F.col("source")).alias("name"), "source_size", "target")
    state = solve_dual(classes.select("name", "size", "n"), targets, float(cap)).select("name", "source_size", "target", "lam", "mean_size", "full")
    state = state.withColumns({"miss": F.col("target"), "steps": F.array().cast("array<struct<limit: double, tau: double>>")})
    state = materialize(state, "mix-state")
    copy = F.explode(F.sequence(F.lit(0), F.lit(cap - 1))).alias("k")
    rows = narrow.where("size > 0").join(state.where("not full"), "name").select("name", "size", _place(float(cap)).alias("v"), copy)
    rows = materialize(rows.select("name", "size", (F.col("k") + F.col("v")).alias("v")), "mix-places")
    for n in range(1 + FIXES):
        state = materialize(_choose(rows, state, cap, n == 0), "mix-state")
    return state.drop("miss")


def _name(source: Column) -> Column:
    """A source as a name that is not null, so that joins need no special case."""
    return F.when(source.isNull(), "-").otherwise(F.concat(F.lit("+"), source.cast("string")))


def _share(id_col: str, text_col: str) -> Column:
    """53 bits of a hash of the id and the text as a number in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(F.col(text_col), F.col(id_col), F.lit(1)), 11) * F.lit(2.0**-53)


def _narrow(docs: DataFrame, id_col: str, text_col: str, source_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    source = F.col(source_col).cast("string")
    columns = [
        F.col(id_col).alias("doc_id"), source.alias("source"), _name(source).alias("name"), word_count(F.col(text_col)).alias("size"),
        _share(id_col, text_col).alias("u"), *[F.col(k).alias(f"keep_{k}") for k in keep],
    ]
    return materialize(docs.select(*columns), "mix-rows")


def _copies(cap: int) -> Column:
    first, tau = _place(float(cap)), _tau()
    taken = reduce(add, [F.when(F.lit(k) + first <= tau, 1).otherwise(0) for k in range(cap)])
    return F.when(F.col("size") == 0, 0).when(F.col("full"), cap).otherwise(taken).cast("long")


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    budget: float = 1.5,
    cap: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, copies, taken, and the ``keep`` columns."""
    narrow = _narrow(docs, id_col, text_col, source_col, keep)
    placed = narrow.join(mixture(narrow, weights, budget, cap), "name").withColumn("copies", _copies(cap))
    kept = [F.col(f"keep_{k}").alias(k) for k in keep]
    return placed.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *kept)


def repeat_rows(
    docs: DataFrame,
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    budget: float = 1.5,
    cap: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The mixture itself: each row of ``docs`` as often as it is taken, with all its columns. A row's copies follow from itself and
    its source's row alone, so texts are scanned and never shuffled."""
    sources = mixture(_narrow(docs, id_col, text_col, source_col), weights, budget, cap)
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _name(F.col(source_col).cast("string")).alias("name"),
                      word_count(F.col(text_col)).alias("size"), _share(id_col, text_col).alias("u"))
    placed = row.join(sources, "name").withColumn("copies", _copies(cap))
    return placed.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def op7_mixing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
