"""Hunks against facts, held to plain Python over random pages and fact values."""

import json
import random
import re

from pyspark.sql import functions as F

from groundwork.operators import drift
from tests.test_cases import brute_tokens

KINDS = dict(drift.TOKENS)


def leaves(value, depth=3):
    """Leaves of a parsed value in order, names of objects sorted."""
    if isinstance(value, dict):
        return [x for k in sorted(value) for x in leaves(value[k], depth - 1)] if depth else []
    if isinstance(value, list):
        return [x for v in value for x in leaves(v, depth - 1)] if depth else []
    return [] if value is None else [str(value)]


def parsed(text):
    """A value's leaves; what is no JSON is one leaf."""
    try:
        return leaves(json.loads(text)) if text[:1] in "[{" else [text]
    except ValueError:
        return [text]


def typed(leaf):
    for c, p in drift.TOKENS:
        if re.fullmatch(p, leaf):
            return c, leaf.lower() if c in ("address", "email") else leaf.replace(",", "") if c == "number" else leaf
    return None


def brute(hunks, facts):
    """{(slug, hunk): {key: (category, old, proposed)}} by loops."""
    index = {k: [t for t in map(typed, parsed(v)) if t] for k, v in facts if v != "unknown"}
    out = {}
    for slug, n, old, new in hunks:
        a, b = brute_tokens("\n".join(old)), brute_tokens("\n".join(new))
        removed, added, found = a - b, b - a, {}
        for key, mine in index.items():
            if not set(mine) & (removed | added):
                continue
            first = next((t for t in mine if t in removed), None)
            kind = [t for c, t in added if first and c == first[0]]
            found[key] = (*first, kind[0] if len(kind) == 1 else None) if first else (None, None, None)
        out[slug, n] = found
    return out


def made(seed):
    rng = random.Random(seed)
    words = ["7", "8%", "1,200", "3.50", "a@e.org", "https://e.org/x", "2026-01-05", "0x" + "ab" * 20, "plain", "5 March 2026"]
    line = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(5)))
    hunks = [(f"p{i % 40}", 1 + i // 40, [line() for _ in range(rng.randrange(3))], [line() for _ in range(rng.randrange(3))]) for i in range(120)]
    value = lambda d: rng.choice([lambda: rng.choice(words), lambda: [value(d - 1) for _ in range(rng.randrange(3))], lambda: {k: value(d - 1) for k in rng.sample("zyx", rng.randrange(4))}])() if d else rng.choice(words)
    values = [value(3) for _ in range(60)]
    facts = [(f"k.{i}", v if isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)] + [("k.u", "unknown"), ("k.e", "{}"), ("k.l", "[]"), ("k.b", "[broken"), ("k.n", '{"a": null, "b": 7}')]
    return hunks, facts + [(f"hot.{i}", "7") for i in range(200)]


def test_facts_of_hunks_equal_loops(spark):
    for seed in (1, 2):
        hunks, facts = made(seed)
        h = spark.createDataFrame(hunks, "slug string, hunk int, old_lines array<string>, new_lines array<string>")
        index = drift.fact_value_index(spark.createDataFrame(facts, "key string, value string"))
        want = brute(hunks, facts)
        got = {}
        for r in drift.propose_value(h, index).collect():
            assert r.key not in got.setdefault((r.slug, r.hunk), {})
            got[r.slug, r.hunk][r.key] = (r.category, r.old_value, r.proposed)
        assert got == {k: v for k, v in want.items() if v}
        assert {(r.slug, r.hunk): (r["keys"], r.unmapped) for r in drift.reconcile(h, index).collect()} == {k: (sorted(v), not v) for k, v in want.items()}
        pages = {}
        for (slug, n), found in sorted(want.items()):
            page = pages.setdefault(slug, [0, 0, {}])
            page[0] += 1
            page[1] += not found
            for key, (_, old, new) in found.items():
                page[2].setdefault(key, (key, old, new))
        assert {r.slug: [r.n_hunks, r.unmapped, {e.key: tuple(e) for e in r.edits}] for r in drift.page_findings(h, index).collect()} == pages


def test_each_side_is_read_once_and_a_hot_token_is_dealt(spark, tmp_path):
    hunks, facts = made(3)
    spark.createDataFrame(hunks, "slug string, hunk int, old_lines array<string>, new_lines array<string>").write.parquet(str(tmp_path / "h"))
    spark.createDataFrame(facts, "key string, value string").write.parquet(str(tmp_path / "f"))
    index = drift.fact_value_index(spark.read.parquet(str(tmp_path / "f")))
    rows = drift.hunk_facts(spark.read.parquet(str(tmp_path / "h")), index)
    plan = rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("FileScan") == 2 and "CartesianProduct" not in plan and "Window" not in plan
    dealt = index.where("token = '7'").groupBy(F.pmod(F.xxhash64("key"), F.lit(8))).count().collect()
    assert len(dealt) == 8 and max(r["count"] for r in dealt) < 60


def test_no_facts_and_no_hunks(spark):
    hunks, facts = made(4)
    h = spark.createDataFrame(hunks, "slug string, hunk int, old_lines array<string>, new_lines array<string>")
    index = drift.fact_value_index(spark.createDataFrame(facts, "key string, value string"))
    assert drift.reconcile(h, index.limit(0)).where("unmapped").count() == len(hunks)
    assert drift.reconcile(h.limit(0), index).count() == drift.page_findings(h.limit(0), index).count() == 0


def test_facts_with_the_same_leaves_are_one_class(spark):
    hunks, facts = made(5)
    h = spark.createDataFrame(hunks, "slug string, hunk int, old_lines array<string>, new_lines array<string>")
    index = drift.fact_value_index(spark.createDataFrame(facts + [("hot.0", "8%")], "key string, value string"))
    classes, members = drift.fact_classes(index, chunk=16)
    hot = classes.where("token = '7'").select("key").distinct()
    assert hot.count() < 60  # 200 facts have this value, 199 of them alone
    chunks = members.collect()
    assert sorted(k for r in chunks for k in r["keys"]) == sorted(r.key for r in index.select("key").distinct().collect())
    assert max(len(r["keys"]) for r in chunks) < 60
    met = drift.hunk_facts(h, classes).where("key is not null").join(members.select(F.col("class").alias("key"), "keys"), "key")
    assert sorted(met.select("slug", "hunk", F.explode("keys"), "old_value", "proposed").collect(), key=str) == sorted(drift.hunk_facts(h, index).where("key is not null").select("slug", "hunk", "key", "old_value", "proposed").collect(), key=str)


def test_lists_are_made_once_for_pages_alike(spark):
    line = lambda x: [f"Price {x}"]
    hunks = [(f"p{i}", 1, line(7), line(8)) for i in range(50)] + [("q", 1, line("a"), line("b")), ("r", 1, line(9), line(8))]
    h = spark.createDataFrame(hunks, "slug string, hunk int, old_lines array<string>, new_lines array<string>")
    index = drift.fact_value_index(spark.createDataFrame([(f"k.{i}", "7") for i in range(300)] + [("k.x", "9")], "key string, value string"))
    calls = spark.sparkContext.accumulator(0)

    def counted(edits):
        calls.add(bool(edits))
        return str(len(edits))

    shown = drift.page_findings(h, index, h.groupBy("slug").count(), show=lambda edits: F.udf(counted)(edits))
    got = {r.slug: (r.n_hunks, r.unmapped, r["count"], r.edits) for r in shown.collect()}
    assert got == {f"p{i}": (1, 0, 1, "300") for i in range(50)} | {"q": (1, 1, 1, "0"), "r": (1, 0, 1, "1")}
    assert calls.value <= 2


def test_a_summary_adds_up_sizes_of_classes(spark):
    hunks, facts = made(6)
    h = spark.createDataFrame(hunks, "slug string, hunk int, old_lines array<string>, new_lines array<string>")
    index = drift.fact_value_index(spark.createDataFrame(facts, "key string, value string"))
    pages = {r.slug: (r.n_hunks, r.unmapped, len(r.edits)) for r in drift.page_findings(h, index).collect()}
    counts = drift.finding_counts(h, index)
    assert {r.slug: (r.n_hunks, r.unmapped, r.n_edits) for r in counts.collect()} == pages
    assert tuple(drift.finding_batch_summary(counts).first()) == (len(pages), sum(p[2] for p in pages.values()), sum(p[1] for p in pages.values()))
    # Keys are counted, and no list of edits stands on any page's row.
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert "edits#" not in plan.replace("n_edits#", "") and "list_id" not in plan
    assert tuple(drift.finding_batch_summary(drift.finding_counts(h.limit(0), index)).first()) == (0, 0, 0)


def test_lists_are_dealt_to_all_partitions(spark):
    line = lambda x: [f"Price {x}"]
    hunks = [(f"p{i}", 1, line(i % 200 + 100), line(7)) for i in range(400)]
    h = spark.createDataFrame(hunks, "slug string, hunk int, old_lines array<string>, new_lines array<string>")
    index = drift.fact_value_index(spark.createDataFrame([(f"k.{i}", str(i % 200 + 100)) for i in range(600)], "key string, value string"))
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        found = drift.page_findings(h, index).withColumn("at", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert {r.slug: len(r.edits) for r in found} == {f"p{i}": 3 for i in range(400)}
    assert len({r["at"] for r in found}) == 16


def broadcast_keys(df):
    """Keys of the joins whose one side is gathered on the driver."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    return [re.sub(r"#\d+L?", "", k) for k in re.findall(r"BroadcastHashJoin \[(.*?)\]", plan)] + re.findall("BroadcastNestedLoopJoin", plan)


def on_disk(spark, tmp_path, seed):
    """Hunks and the index of facts from files, whose sizes Spark knows."""
    hunks, facts = made(seed)
    spark.createDataFrame(hunks, "slug string, hunk int, old_lines array<string>, new_lines array<string>").write.parquet(str(tmp_path / "h"))
    spark.createDataFrame(facts, "key string, value string").write.parquet(str(tmp_path / "f"))
    return spark.read.parquet(str(tmp_path / "h")), drift.fact_value_index(spark.read.parquet(str(tmp_path / "f")))


def test_proposals_broadcast_no_keys_and_no_pages(spark, tmp_path):
    h, index = on_disk(spark, tmp_path, 7)
    assert set(broadcast_keys(drift.propose_value(h, index))) <= {"a, b"}  # classes of more than a chunk only
    pages = spark.createDataFrame([("p", "x"), ("q", "y")], "slug string, text string")
    pages.write.parquet(str(tmp_path / "p"))
    pages = spark.read.parquet(str(tmp_path / "p"))
    assert not broadcast_keys(drift.page_hunks(pages, pages.withColumn("text", F.concat("text", F.lit("z")))))
    # A class whose keys are dealt to many rows.
    classes, members = drift.fact_classes(index, chunk=16)
    rows = drift.hunk_facts(h, classes).where("key is not null").withColumnRenamed("key", "class")
    got = drift._with_keys(rows, members).select("slug", "hunk", F.explode("keys").alias("key"), "category", "old_value", "proposed").collect()
    assert members.where("class.n > 8").count() > 8
    assert sorted(got, key=str) == sorted(drift.hunk_facts(h, index).where("key is not null").select("slug", "hunk", "key", "category", "old_value", "proposed").collect(), key=str)


def test_lists_of_keys_and_edits_are_not_broadcast(spark, tmp_path):
    h, index = on_disk(spark, tmp_path, 8)
    assert set(broadcast_keys(drift.page_findings(h, index)) + broadcast_keys(drift.reconcile(h, index))) <= {"a, b"}
    # A class of more keys than a row of them takes, in one list.
    classes, members = drift.fact_classes(index, chunk=16)
    rows = drift.hunk_facts(h, classes).where("key is not null").groupBy("slug", "hunk").agg(F.collect_list(F.struct(F.col("key").alias("class"))).alias("classes"))
    got = {(r.slug, r.hunk): r["keys"] for r in drift._listed(rows, members, lambda k, e: k, "array<string>", "keys").collect()}
    assert got == {(r.slug, r.hunk): r["keys"] for r in drift.reconcile(h, index).where("not unmapped").collect()}


def test_fingerprints_and_sizes_are_not_broadcast(spark, tmp_path):
    h, index = on_disk(spark, tmp_path, 9)
    h = h.withColumn("op", F.lit("replace"))
    full = drift.page_findings(h, index, drift.fingerprint_hunks(h), drift.diff_text(h), show=drift.edit_lines)
    assert set(broadcast_keys(full) + broadcast_keys(drift.finding_counts(h, index))) <= {"a, b"}
