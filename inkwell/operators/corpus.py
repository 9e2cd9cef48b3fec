"""Inventory, duplicates, folds and their reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import decide, text
from ..schemas import require_columns


def inventory(files: DataFrame) -> DataFrame:
    """One row a file from (relative_path, absolute_path, file_size_bytes,
    text, encoding, error, replacements); unreadable ones are ``failed``."""
    stem = F.regexp_replace(F.substring_index("relative_path", "/", -1), r"\.[^.]*$", "")
    ok = F.col("text").isNotNull()
    whole = F.coalesce("text", F.lit(""))
    return files.select(
        F.sha1(F.replace("relative_path", F.lit("\\"), F.lit("/"))).alias("novel_id"),
        F.substring_index("relative_path", "/", -1).alias("file_name"),
        stem.alias("file_stem"),
        "relative_path",
        "absolute_path",
        "file_size_bytes",
        F.round(F.col("file_size_bytes") / 1048576, 4).alias("file_size_mb"),
        F.col("encoding").alias("detected_encoding"),
        F.when(ok, "ok").otherwise("failed").alias("read_status"),
        F.col("error").alias("error_message"),
        text.title_from_stem(stem).alias("title_guess"),
        text.author_from_stem(stem).alias("author_guess"),
        F.length(whole).alias("char_count"),
        text.chapter_estimate(whole).alias("estimated_chapter_count"),
        F.when(ok, text.fingerprint(F.col("text"))).otherwise("").alias("content_sha256"),
        F.coalesce("replacements", F.lit(0)).alias("decode_replacement_chars"),
        F.lit(False).alias("is_duplicate"),
        F.lit(None).cast("string").alias("duplicate_of"),
        F.when(ok, text.sample_text(F.col("text"))).otherwise("").alias("sample_text"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("created_at"),
    )


def exact_duplicates(rows: DataFrame, *, key: str, content: str, order: str, usable: Column | None = None) -> DataFrame:
    """Adds is_duplicate and duplicate_of: of equal contents the first in
    ``order`` stays; rows that are not usable or have no content are left alone.

    The first row of each content is found by an aggregation, which combines
    before it shuffles, and joined back; so a content that many rows share is
    no single task's work.
    """
    counted = F.coalesce((F.col(content) != ""), F.lit(False)) & (F.lit(True) if usable is None else F.coalesce(usable, F.lit(False)))
    rows = rows.drop("is_duplicate", "duplicate_of")
    marked = rows.withColumn("__content", F.when(counted, F.col(content)))
    first = marked.where("__content IS NOT NULL").groupBy("__content").agg(F.min_by(F.col(key), F.struct(order, key)).alias("__first"))
    joined = marked.join(first, "__content", "left")
    same = F.coalesce(F.col("__first") != F.col(key), F.lit(False))
    return joined.withColumns({"is_duplicate": same, "duplicate_of": F.when(same, F.col("__first"))}).drop("__content", "__first")


def near_duplicates(
    rows: DataFrame, *, key: str, title: str, author: str, length: str, order: str, tolerance: float = 0.05, usable: Column | None = None
) -> DataFrame:
    """Marks further rows that share title and author with a longest one, if
    their lengths agree within ``tolerance``. Exact duplicates take no part."""
    counted = ~F.col("is_duplicate") & (F.trim(F.col(author)) != "") & (F.col(title) != "")
    counted = F.coalesce(counted & (F.lit(True) if usable is None else usable), F.lit(False))
    marked = rows.withColumns({"__t": F.when(counted, F.trim(F.col(title))), "__a": F.when(counted, F.trim(F.col(author)))})
    best = F.min(F.struct((-F.col(length)).alias("n"), F.col(order).alias("o"), F.col(key).alias("k"))).alias("best")
    longest = marked.where("__t IS NOT NULL AND __a IS NOT NULL").groupBy("__t", "__a").agg(best)
    longest = longest.select("__t", "__a", F.col("best.k").alias("__first"), (-F.col("best.n")).alias("__most"))
    joined = marked.join(longest, ["__t", "__a"], "left")
    close = (F.col("__most") > 0) & ((F.col("__most") - F.col(length)) / F.col("__most") <= tolerance)
    near = F.coalesce((F.col("__first") != F.col(key)) & close, F.lit(False))
    return joined.withColumns(
        {"is_near": near, "is_duplicate": F.col("is_duplicate") | near, "duplicate_of": F.when(near, F.col("__first")).otherwise(F.col("duplicate_of"))}
    ).drop("__t", "__a", "__first", "__most")


def duplicate_report(rows: DataFrame, *, title: str = "title_guess", status: str | None = "read_status") -> DataFrame:
    """Exact and near duplicates, distinct originals, and title collisions."""
    alive = ~F.col("is_duplicate") & ((F.col(status) == "ok") if status else F.lit(True))
    return rows.agg(
        F.count_if(F.col("is_duplicate") & ~F.col("is_near")).alias("exact_duplicates"),
        F.count_if("is_near").alias("near_duplicates"),
        F.count_distinct("duplicate_of").alias("originals"),
        (F.count(F.when(alive, F.col(title))) - F.count_distinct(F.when(alive, F.col(title)))).alias("title_collisions"),
    )


def inventory_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(F.col("read_status") == "ok").alias("readable"),
        F.count_if(F.col("read_status") != "ok").alias("failed"),
        F.sum("file_size_mb").alias("megabytes"),
        F.avg(F.when(F.col("read_status") == "ok", F.col("estimated_chapter_count"))).alias("mean_chapters"),
    )


def usable(rows: DataFrame) -> DataFrame:
    """Readable rows that duplicate none."""
    return rows.where((F.col("read_status") == "ok") & ~F.coalesce("is_duplicate", F.lit(False)))


def splits(rows: DataFrame, fraction: float = 0.2) -> DataFrame:
    """The fold of every usable row with a content hash."""
    require_columns(rows, "novel_id", "content_sha256", "read_status", "is_duplicate")
    kept = usable(rows).where(F.coalesce(F.col("content_sha256"), F.lit("")) != "")
    title = ["title_guess"] if "title_guess" in rows.columns else []
    return kept.select("novel_id", "content_sha256", *title, decide.fold(F.col("content_sha256"), fraction).alias("fold"))


def fold_report(folds: DataFrame) -> DataFrame:
    return folds.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("fold") == "train").alias("train_rows"),
        F.count_if(F.col("fold") == "eval").alias("eval_rows"),
        F.avg((F.col("fold") == "eval").cast("double")).alias("eval_share"),
    )


def filter_fold(rows: DataFrame, folds: DataFrame, fold: str, key: str = "novel_id") -> DataFrame:
    """Rows of one fold; ids without a fold are dropped. Keeps the columns."""
    require_columns(rows, key)
    wanted = folds.where(F.col("fold") == fold).select(F.col(key))
    return rows.join(wanted.distinct(), key, "left_semi").select(*rows.columns)


def leakage(a: DataFrame, b: DataFrame, folds: DataFrame, key: str = "novel_id") -> DataFrame:
    """Sizes of two sets of ids, their overlap, and ids in the wrong fold."""
    left, right = a.select(key).distinct(), b.select(key).distinct()
    known = folds.select(key, "fold").distinct()
    # One row an id, with its sides; sizes then need one pass.
    sides = left.withColumn("l", F.lit(1)).join(right.withColumn("r", F.lit(1)), key, "full").join(known, key, "left")
    return sides.agg(
        F.count("l").alias("train_size"),
        F.count("r").alias("eval_size"),
        F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("overlap"),
        F.count_if(F.col("l").isNotNull() & (F.col("fold") == "eval")).alias("eval_in_train"),
        F.count_if(F.col("r").isNotNull() & (F.col("fold") == "train")).alias("train_in_eval"),
    )


def density_table(rows: DataFrame, words: list[str], key: str = "novel_id", text_col: str = "text") -> DataFrame:
    """Densities of all words in the raw text, one column each."""
    return rows.select(key, F.length(text_col).alias("char_count"), *[text.density(F.col(text_col), w).alias(w) for w in words])


def exact_quantiles(rows: DataFrame, value: str, group: str, shares: tuple[float, ...], accuracy: int = 100_000) -> DataFrame:
    """(group, quantiles): exact quantiles, interpolated between neighbours.

    A sketch of bounded size gives an interval around each quantile; what lies
    below is counted, and only the values inside are sorted, equal ones as one
    row. A group of up to ``accuracy`` values is sorted as a whole. Nulls are
    left out.
    """
    v = rows.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"))
    room = 4 / accuracy
    bounds = [(max(p - room, 0.0), min(p + room, 1.0)) for p in shares]
    sketch = F.percentile_approx("v", F.array(*[F.lit(x) for b in bounds for x in b]), accuracy)
    ends = v.groupBy("g").agg(F.count(F.lit(1)).alias("n"), sketch.alias("q"))
    small = F.col("n") <= accuracy
    spans = F.array(*[
        F.struct(F.lit(i).alias("i"), F.when(small, float("-inf")).otherwise(F.get("q", F.lit(2 * i))).alias("low"), F.when(small, float("inf")).otherwise(F.get("q", F.lit(2 * i + 1))).alias("high"), (F.lit(p) * (F.col("n") - 1)).alias("at"))
        for i, p in enumerate(shares)
    ])
    met = v.join(ends.select("g", spans.alias("spans")), "g")
    below = met.groupBy("g").agg(F.array(*[F.count_if(F.col("v") < F.get("spans", F.lit(i))["low"]) for i in range(len(shares))]).alias("below"))
    inside = met.select("g", "v", F.explode(F.filter("spans", lambda s: (s["low"] <= F.col("v")) & (F.col("v") <= s["high"]))).alias("s"))
    inside = inside.groupBy("g", "s.i", "s.at", "v").agg(F.count(F.lit(1)).alias("m")).join(below, "g")
    order = W.partitionBy("g", "i").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    last = inside.withColumn("last", F.get("below", F.col("i")) + F.sum("m").over(order) - 1)
    reached = lambda rank: F.min(F.when(F.col("last") >= rank, F.col("v")))
    pair = last.groupBy("g", "i", "at").agg(reached(F.floor("at")).alias("a"), reached(F.ceil("at")).alias("b"))
    found = pair.withColumn("x", F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.floor("at")))
    found = found.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("xs"))
    return found.select(F.col("g").alias(group), F.transform("xs", lambda s: s["x"]).alias("quantiles"))


def density_summary(table: DataFrame, words: list[str]) -> DataFrame:
    """By word: median, 90th percentile, maximum, and shares beyond the cuts."""
    long = table.select(F.explode(F.array(*[F.struct(F.lit(w).alias("term"), F.col(f"`{w}`").alias("d")) for w in words])).alias("x")).select("x.*")
    rest = long.groupBy("term").agg(
        F.max("d").alias("max"),
        F.avg((F.col("d") >= decide.VIOLATING).cast("double")).alias("violating_share"),
        F.avg((F.col("d") <= decide.CLEAN).cast("double")).alias("clean_share"),
    )
    q = exact_quantiles(long, "d", "term", (0.5, 0.9)).select("term", F.get("quantiles", F.lit(0)).alias("median"), F.get("quantiles", F.lit(1)).alias("p90"))
    return q.join(rest, "term")


def profile_status(rows: DataFrame) -> Column:
    """Why a row has no profile, in the order in which reasons count."""
    return (
        F.when(F.col("read_status") != "ok", "failed")
        .when(F.coalesce("is_duplicate", F.lit(False)), "duplicate")
        .when(~F.coalesce("file_exists", F.lit(True)), "missing")
        .when(F.col("text").isNull(), "read_error")
        .otherwise("ok")
    )


def rows_for_index(profiles: DataFrame, least: int = 50, limit: int | None = None, order: str = "novel_id") -> DataFrame:
    """Profiles with an id and a text of enough characters. A limit takes the
    first rows by ``order`` before anything is dropped."""
    require_columns(profiles, "novel_id", "profile_text")
    some = profiles if limit is None else profiles.orderBy(order).limit(limit)
    return some.where(F.col("novel_id").isNotNull() & (F.length("profile_text") >= least))


def first_of(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key by an explicit order."""
    n = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__n", n).where("__n = 1").drop("__n")
