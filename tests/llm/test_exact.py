from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest
from compare import rows
from pyspark.sql import functions as F

from inkwell.llm import exact


def brute(data):
    groups = defaultdict(list)
    for r in data:
        groups[r["text"] or ""].append(r["doc_id"])
    out, seen = [], set()
    for r in data:
        text = r["text"] or ""
        known = [i for i in groups[text] if i is not None]
        keep = max(known) if known else None
        kept = r["doc_id"] == keep and text not in seen  # one row, also where rows repeat the id
        seen |= {text} if kept else set()
        out.append((r["doc_id"], keep, len(groups[text]), kept, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def plain_digest(text):
    return F.unhex(F.sha2(text, 256))


def one_digest(text):
    """The same digest for all texts, so that only whole texts tell them apart."""
    return F.lit(b"same")


@pytest.mark.parametrize("digest", [plain_digest, one_digest])
@pytest.mark.parametrize("salts", [1, 16])
def test_labels_agree_with_brute_force(hard, documents, digest, salts):
    for df in (hard, documents):
        found = exact.label_copies(df, digest=digest, salts=salts)
        assert rows(found) == brute(df.collect())
        assert found.where("kept").count() == exact.drop_copies(df, digest=digest, salts=salts).count()


def test_kept_rows_keep_their_columns(hard, clashing):
    kept = exact.drop_copies(clashing)
    assert kept.columns == clashing.columns
    assert kept.count() == hard.select(F.coalesce("text", F.lit(""))).distinct().count()
    found = {r["text"]: r for r in kept.collect()}
    assert found["one two three four five"]["doc_id"] == 6 and found["one two three four five"]["source"] == "b"
    assert exact.drop_copies(hard, digest=one_digest).count() == kept.count()


def test_empty(none):
    assert exact.label_copies(none).count() == exact.drop_copies(none).count() == 0


def test_a_group_of_a_third_of_all_rows(spark):
    df = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text")).repartition(20)
    hot = exact.label_copies(df).where("group_size > 1")
    assert hot.count() == 10_000 and hot.where("kept").collect()[0]["doc_id"] == 29_997
