"""Graphs, fusion, references, upkeep, sections, streams and scans on small tables."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from corvane.operators import graph, references, retrieval, sections, snapshots
from corvane.sources.trees import scan_tree
from corvane.streaming import events

EDGES = "repo string, class_name string, used_class string, n_chunks int"


def edges(spark, *pairs):
    return spark.createDataFrame([("r", a, b, 1) for a, b in pairs], EDGES)


def test_activation_sends_along_edges_both_ways(spark):
    seeds = spark.createDataFrame([("r", "A")], "repo string, class_name string")
    found = graph.spread_activation(edges(spark, ("A", "B"), ("B", "A"), ("C", "A"), ("C", "D"), ("D", "D"), ("A", "B")), seeds)
    assert {r.class_name: round(r.energy, 3) for r in found.collect()} == {"B": 1.4, "C": 0.7, "D": 0.49}
    assert graph.spread_activation(edges(spark), seeds).count() == 0


def test_page_rank_keeps_its_sum(spark):
    star = [(f"C{i}", "Hub") for i in range(300)] + [("Hub", "End")]
    ranks = {r.class_name: r.page_rank for r in graph.page_rank(edges(spark, *star)).collect()}
    assert len(ranks) == 302 and sum(ranks.values()) == pytest.approx(1)
    assert ranks["Hub"] > ranks["C1"] and ranks["End"] > ranks["C1"]
    assert graph.page_rank(edges(spark)).count() == 0


def test_communities_of_two_cliques(spark):
    cliques = [(a, b) for group in ("ABCD", "WXYZ") for a in group for b in group if a < b]
    found = {r.class_name: r.community for r in graph.communities(edges(spark, *cliques)).collect()}
    assert {found[c] for c in "ABCD"} == {"A"} and {found[c] for c in "WXYZ"} == {"W"}


def test_labels_settle(spark):
    pairs = [("A", "B"), ("C", "D"), ("D", "E"), ("E", "F"), ("F", "C"), *((f"L{i}", "Hub") for i in range(40))]
    found = {r.class_name: r.community for r in graph.communities(edges(spark, *pairs)).collect()}
    assert found["A"] == found["B"] and len({found[f"L{i}"] for i in range(40)} | {found["Hub"]}) == 1
    assert graph.communities(edges(spark)).count() == 0


def test_fusion_and_scores(spark):
    one = spark.createDataFrame([("q", "x", 1), ("q", "y", 2)], "q string, v string, rank int")
    two = spark.createDataFrame([("q", "y", 1), ("q", "z", None)], "q string, v string, rank int")
    fused = {r.v: r.fused for r in retrieval.fuse_ranks([one, two], ["q", "v"]).collect()}
    assert fused["y"] == pytest.approx(1 / 61 + 1 / 62) and fused["x"] == pytest.approx(1 / 61) and fused["z"] is None
    d = spark.createDataFrame([(x,) for x in (-1.0, 1.0, 2.0, 3.0, 3.3, 9.0)], "d double")
    at = [F.lit(float(x)) for x in (1, 2, 3)]
    assert [r[0] for r in d.select(F.round(retrieval.score(F.col("d"), *at), 1)).collect()] == [100, 85, 55, 15, 7.5, 0]
    assert [r[0] for r in d.select(retrieval.confidence(F.col("d"), *at)).collect()] == ["HIGH", "MEDIUM", "LOW"] + ["NO MATCH"] * 3
    none = spark.createDataFrame([], "distance double")
    assert tuple(retrieval.calibrate(none, none).first()) == (None, None, None)


CHUNKS = "chunk_no bigint, repo string, file_path string, class_name string, start_line int, source string, chunk_type string, indexed_at timestamp_ntz"


def test_references(spark):
    t = datetime(2024, 1, 1)
    rows = [
        (1, "r", ".\\a.cs", "Door", 3, "public class Door\r\n{ Door Next; }", " Whole_Class", t),
        (2, "r", "./a.cs", "Door", 3, "public class Door\n", "method", None),
        (3, "r", "b.rs", "Key", 1, "struct Key { d: Door, e: Nothing }\nDoor Door", "whole_class", t),
        (4, "q", "c.cs", None, 1, "Door", "method", t), (5, "r", "d.cs", "X", None, "Door", "method", t), (6, "r", None, "X", 1, None, None, None),
    ]
    found = {(r.symbol, r.file_path, r.line_no, r.tag) for r in references.class_references(spark.createDataFrame(rows, CHUNKS)).collect()}
    assert found == {("Door", "a.cs", 3, "DEF"), ("Door", "a.cs", 4, "REF"), ("Door", "b.rs", 1, "REF"), ("Door", "b.rs", 2, "REF"), ("Key", "b.rs", 1, "DEF")}
    assert references.class_references(spark.createDataFrame([], CHUNKS)).count() == 0


def test_manifests_and_replacement(spark):
    table = lambda rows: spark.createDataFrame(rows, "k string, s string")
    old, new = table([("a", "1"), ("b", "1"), ("c", None), ("d", "1"), (None, "1")]), table([("a", "1"), ("b", "2"), ("c", None), ("e", "1")])
    found = {r.k: r.status for r in snapshots.manifest_diff(old, new, "k", "s").collect()}
    assert found == {"a": "unchanged", "b": "changed", "c": "unchanged", "d": "removed", "e": "new"}
    once = snapshots.replace_keys(old.where("k is not null"), new, ["k"])
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, snapshots.replace_keys(once, new, ["k"]).collect()), key=str)
    assert once.where("k = 'b'").first().s == "2" and once.count() == 5


def test_sections_give_the_text_back(spark):
    texts = ["", None, "# A\r\nb\n## C\n", "x\r#no\n### D", "#\n####### E"]
    made = sections.heading_sections(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    for i, text in enumerate(texts):
        parts = [r.section for r in sorted((r for r in made if r.doc_id == i), key=lambda r: r.position)]
        assert parts == [] if text is None else "\n".join(parts) == text.replace("\r\n", "\n").replace("\r", "\n")
    assert {(r.level, r.title) for r in made} == {(0, ""), (1, "A"), (2, "C"), (3, "D")}


def test_streams_of_several_files(spark, tmp_path):
    kind = "event_id bigint, ts timestamp_ntz, event_type string, value double"
    for i, hours in enumerate(((1, 1, 2), (2, 3))):
        rows = [(10 * i + j, datetime(2024, 1, 1, h, j), "view", 1.0) for j, h in enumerate(hours)]
        spark.createDataFrame(rows + [(0, datetime(2024, 1, 1, 1), "view", 1.0)], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    counts = events.drain_updates(events.window_counts(events.event_stream(spark, str(tmp_path / "e")), late="1 day"), ["window_start", "event_type"])
    assert {(r.window_start.hour, r.n_events) for r in counts.collect()} == {(1, 4), (2, 2), (3, 1)}
    assert events.drain_rows(events.without_repeats(events.event_stream(spark, str(tmp_path / "e")), late="1 day")).count() == 5


def test_scan_of_a_tree(spark, tmp_path):
    for path, data in {"a.py": b"x = 1\n", "src/b.cs": "é".encode(), "node_modules/c.py": b"", "src/d.png": b"\x89"}.items():
        (tmp_path / path).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / path).write_bytes(data)
    found = {(r.rel_path, r.source, r.n_bytes) for r in scan_tree(spark, str(tmp_path), "me", ["py", "cs"], skip=["node_modules"]).collect()}
    assert found == {("a.py", "x = 1\n", 6), ("src/b.cs", "é", 2)}
