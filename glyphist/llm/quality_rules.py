"""Quality rules: base counts of a text, and robust multivariate outliers among its peers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphist.llm.steps import Steps

MIN_WORDS = 50
REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
WHITE_SPACE = " \t\n\x0b\x0c\r"

# Statistics are whole numbers, this many steps to a unit: sums over any number of rows are exact.
STEPS = 64
DIM = 4
# Share of a group that the estimates rest on, and the number of concentration steps.
CORE_SHARE = 0.75
CONCENTRATIONS = 4
BINS = 1 << 14
# Groups with fewer rows are judged with their language, and languages with all texts.
MIN_GROUP = 200
# Least standard deviations: for statistics that are the same in most texts.
FLOORS = (16.0, 48.0, 48.0, 48.0)
# For 4 dimensions and a share of 0.75: share / P(chi2 with 6 < 5.385), makes the scatter of the
# core comparable with that of all rows.
CONSISTENCY = 1.4866
# A text is rejected beyond this squared distance: 1 in 10^9 of normal rows has a larger one.
CUTOFF = 48.6

STATS = ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_AXES = tuple(range(1, DIM + 1))
_PAIRS = tuple((i, j) for i in _AXES for j in range(1, i + 1))


def text_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of whole texts.

    Null texts have no words. Each array is a step of its own, so that it is made once.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    steps = docs.withColumn("_words", F.filter(F.split(text, r"[ \x09-\x0d]+"), lambda w: w != ""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(WHITE_SPACE)) != "")
    steps = steps.withColumn("_lines", lines).withColumn("_joined", F.array_join("_words", ""))
    bare = F.col("_joined")
    for symbol in SYMBOLS:
        bare = F.replace(bare, F.lit(symbol))
    # Hash and place of every three-word window, in order of the hashes.
    windows = F.transform(
        "_words",
        lambda w, i: F.struct(
            F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2)).alias("h"), i.alias("i")
        ),
    )
    sorted_windows = F.sort_array(F.slice(windows, F.lit(1), F.greatest(F.size("_words") - 2, F.lit(0))))
    steps = steps.withColumn("_windows", sorted_windows)
    repeated = F.filter(
        "_windows",
        lambda w, k: w["h"].eqNullSafe(F.get("_windows", k + 1)["h"])
        | w["h"].eqNullSafe(F.get("_windows", k - 1)["h"]),
    )
    steps = steps.withColumn("_repeated", F.sort_array(F.transform(repeated, lambda w: w["i"])))
    # Words covered by windows of three: 3 for each, less what the next one covers too.
    covered = F.transform(
        "_repeated", lambda p, k: F.least(F.coalesce(F.get("_repeated", k + 1) - p, F.lit(3)), F.lit(3))
    )
    return steps.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.size("_words").cast("long").alias("n_words"),
        F.length("_joined").cast("long").alias("word_chars"),
        (F.length("_joined") - F.length(bare)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.aggregate(covered, F.lit(0), lambda a, b: a + b).cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def _steps(value: Column) -> Column:
    return F.floor(value * STEPS + 0.5).cast("long")


def _logged(count: str) -> Column:
    """log2 of 1 and the count per hundred words."""
    return _steps(F.log2(F.lit(1.0) + F.col(count) * 100.0 / F.col("n_words")))


def vectors(stats: DataFrame) -> DataFrame:
    """Add x1 to x4: mean word length, and logs of symbols, equal lines and repeated words."""
    return stats.withColumns(
        {
            "x1": _steps(F.col("word_chars") / F.col("n_words")),
            "x2": _logged("n_symbols"),
            "x3": _logged("n_dup_lines"),
            "x4": _logged("n_repeat_words"),
        }
    )


def _group_name(*columns: str) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def groups_of_pairs(rows: DataFrame, steps: Steps) -> DataFrame:
    """``(_lang, _source, g, gs)`` of every pair of language and source.

    ``g`` is what its rows are judged with: language and source, or language, or all, the first
    with enough rows. ``gs`` has all groups that the rows count for: of the pair, the language
    and all, those that some row is judged with.
    """
    pairs = rows.groupBy("lang", "source").agg(F.count("*").alias("n"))
    of_lang = Window.partitionBy("lang")
    enough = F.col("n") >= MIN_GROUP
    sized = pairs.withColumn("n_lang", F.sum("n").over(of_lang)).select(
        "lang",
        "source",
        F.when(enough, _group_name("lang", "source"))
        .when(F.col("n_lang") >= MIN_GROUP, _group_name("lang"))
        .otherwise(F.lit("all"))
        .alias("g"),
        F.when(enough, _group_name("lang", "source")).alias("_pair"),
        # The least pair tells if any is too small to be judged alone.
        F.when((F.min("n").over(of_lang) < MIN_GROUP) & (F.col("n_lang") >= MIN_GROUP), _group_name("lang")).alias("_whole"),
    )
    names = steps.keep(sized.withColumnsRenamed({"lang": "_lang", "source": "_source"}), "groups")
    everything = F.lit("all") if names.filter("g = 'all'").limit(1).count() else F.lit(None).cast("string")
    listed = F.array_compact(F.array("_pair", "_whole", everything))
    return steps.keep(names.withColumn("gs", listed).drop("_pair", "_whole"), "groups")


def with_group(rows: DataFrame, names: DataFrame) -> DataFrame:
    """``rows`` with ``g`` and ``gs`` of their pair."""
    match = rows["lang"].eqNullSafe(names["_lang"]) & rows["source"].eqNullSafe(names["_source"])
    return rows.join(names, match).drop("_lang", "_source")


def start(rows: DataFrame, steps: Steps) -> DataFrame:
    """First estimates ``(g, m1.., l11, l21..)``: medians, and median deviations as a diagonal.

    Medians of whole numbers in a small range are exact and need one count per number.
    """
    medians = rows.groupBy("g").agg(*[F.percentile(f"x{i}", F.lit(0.5)).alias(f"m{i}") for i in _AXES])
    medians = steps.keep(medians, "medians")
    deviations = rows.join(medians, "g").groupBy("g").agg(
        *[F.percentile(F.abs(F.col(f"x{i}") - F.col(f"m{i}")), F.lit(0.5)).alias(f"s{i}") for i in _AXES]
    )
    factors = [
        (F.greatest(F.lit(1.4826) * F.col(f"s{i}"), F.lit(FLOORS[i - 1])) if i == j else F.lit(0.0)).alias(f"l{i}{j}")
        for i, j in _PAIRS
    ]
    return medians.join(deviations, "g").select("g", *[f"m{i}" for i in _AXES], *factors)


def with_distance(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """Add ``d2``, the squared Mahalanobis distance, by forward substitution."""
    joined = rows.join(estimates, "g")
    for i in _AXES:
        rest = F.col(f"x{i}") - F.col(f"m{i}")
        for j in range(1, i):
            rest = rest - F.col(f"l{i}{j}") * F.col(f"y{j}")
        joined = joined.withColumn(f"y{i}", rest / F.col(f"l{i}{i}"))
    square = F.col("y1") * F.col("y1")
    for i in _AXES[1:]:
        square = square + F.col(f"y{i}") * F.col(f"y{i}")
    return joined.withColumn("d2", square).select(*rows.columns, "d2")


def concentrated(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """Estimates from the rows nearest to the given ones.

    Rows are summed by group and narrow bin of distance, before and after the shuffle; the
    core is the bins that hold the nearest share of the group. The last of at most
    ``BINS`` bins of a group takes all larger distances.
    """
    moments = [F.sum(f"x{i}").alias(f"t{i}") for i in _AXES]
    moments += [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"t{i}{j}") for i, j in _PAIRS]
    bin_of = F.least(F.floor(F.sqrt("d2") * 16).cast("long"), F.lit(BINS - 1))
    bins = with_distance(rows, estimates).groupBy("g", bin_of.alias("bin")).agg(F.count("*").alias("n"), *moments)
    upto = Window.partitionBy("g").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    nearer = F.coalesce(F.sum("n").over(upto), F.lit(0))
    core = bins.withColumn("_core", nearer < F.sum("n").over(Window.partitionBy("g")) * CORE_SHARE).filter("_core")
    names = ["n", *[f"t{i}" for i in _AXES], *[f"t{i}{j}" for i, j in _PAIRS]]
    sums = core.groupBy("g").agg(*[F.sum(c).cast("double").alias(c) for c in names])
    return factored(sums)


def factored(sums: DataFrame) -> DataFrame:
    """Means and the lower triangular factor of the scaled, floored scatter matrix."""
    df = sums.withColumns({f"m{i}": F.col(f"t{i}") / F.col("n") for i in _AXES})
    scatters = {}
    for i, j in _PAIRS:
        scatter = (F.col(f"t{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")) * CONSISTENCY
        if i == j:
            scatter = F.greatest(scatter, F.lit(0.0)) + F.lit(FLOORS[i - 1] * FLOORS[i - 1])
        scatters[f"c{i}{j}"] = scatter
    df = df.withColumns(scatters)
    for j in _AXES:
        rest = {}
        for i in range(j, DIM + 1):
            rest[i] = F.col(f"c{i}{j}")
            for k in range(1, j):
                rest[i] = rest[i] - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        # The floor keeps the matrix positive definite; the least value only meets rounding.
        df = df.withColumn(f"l{j}{j}", F.sqrt(F.greatest(rest[j], F.lit(1.0))))
        if j < DIM:
            df = df.withColumns({f"l{i}{j}": rest[i] / F.col(f"l{j}{j}") for i in range(j + 1, DIM + 1)})
    return df.select("g", *[f"m{i}" for i in _AXES], *[f"l{i}{j}" for i, j in _PAIRS])


def estimated(stats: DataFrame, steps: Steps, concentrations: int = CONCENTRATIONS) -> tuple[DataFrame, DataFrame]:
    """``(names, estimates)``: what pairs of language and source are judged with, and how.

    ``stats`` is a written table with lang, source and the counts of each row. Only its
    narrow columns are read, once for each group that a row counts for; groups are small
    tables joined as Spark chooses by their size, and all sums combine before they are
    shuffled. All other tables that were written on the way are removed.
    """
    passed = stats.filter(~base_failed())
    names = groups_of_pairs(passed, steps)
    core = vectors(with_group(passed, names)).select(F.explode("gs").alias("g"), *[f"x{i}" for i in _AXES])
    core = steps.keep(core, "vectors")
    estimates = steps.keep(start(core, steps), "estimates")
    for _ in range(concentrations):
        estimates = steps.keep(concentrated(core, estimates), "estimates")
    return names, estimates


def judged(stats: DataFrame, names: DataFrame, estimates: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """``stats`` with ``base_failed``, ``d2`` (null where the base rules failed) and ``kept``.

    Rows are not moved unless the estimates are too many to be sent to them.
    """
    marked = stats.withColumn("base_failed", base_failed())
    rows = vectors(with_group(marked.filter(~F.col("base_failed")), names))
    measured = with_distance(rows, estimates).drop("g", "gs", *[f"x{i}" for i in _AXES])
    failed = marked.filter("base_failed").withColumn("d2", F.lit(None).cast("double"))
    return measured.unionByName(failed).withColumn("kept", F.coalesce(F.col("d2") <= cutoff, F.lit(False)))


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, d2)``.

    One row per row of ``docs``, which needs lang and source; null is a language and a source
    like any other. Null, empty and wordless texts fail the base rules. Equal rows have equal
    verdicts, an empty table gives no rows; other columns are not read.
    """
    stats = text_statistics(
        docs.select(F.col(id_col).alias("doc_id"), "lang", "source", F.col(text_col).alias("text"))
    ).drop("text")
    steps = Steps(docs.sparkSession, "quality")
    stats = steps.keep(stats, "stats")
    names, estimates = estimated(stats, steps)
    steps.leave(stats, names, estimates)
    return judged(stats, names, estimates).select(
        "doc_id", "n_words", *STATS, "base_failed", "kept", F.round("d2", 6).alias("d2")
    )


def good_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``quality_verdicts`` keeps, with all their columns.

    Only the counts are written and read to find the estimates. The counts of a row are taken a
    second time for its verdict, in the pass that returns it, so that no copy of the texts
    is made.
    """
    steps = Steps(docs.sparkSession, "quality")
    named = docs.select("lang", "source", F.col(text_col).alias("text"))
    stats = steps.keep(text_statistics(named).drop("text"), "stats")
    names, estimates = estimated(stats, steps)
    steps.leave(names, estimates)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = text_statistics(docs.select(whole, "lang", "source", F.col(text_col).alias("text"))).drop("text")
    # A condition on a row number is not moved below it: the counts are taken once, and not in place of their names.
    rows = rows.withColumn("_place", F.monotonically_increasing_id()).filter(~base_failed() & (F.col("_place") >= 0))
    passed = vectors(with_group(rows, names))
    return with_distance(passed, estimates).filter(F.col("d2") <= CUTOFF).select("row.*")
