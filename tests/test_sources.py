"""Scans, folders, modules, metadata, bindings, assemblies, suggestions, lines, the index: on small tables."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from corvane.operators import assets, bindings, dependencies, index, lines, projections, search, suggestions
from corvane.sources import sinks, trees


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_excludes(spark):
    paths = ["a.cs", "obj/a.cs", "x/obj/y.py", "b.d.ts", "b.ts", "c_test.go", "gen/v1/a.go", "A.META", None]
    hit = trees.Excludes.of(["*.meta", "*.d.ts", "obj/", "*_test.go", "gen/v1"]).hit(F.col("p"))
    kept = spark.createDataFrame([(p,) for p in paths], "p string").where(~hit)
    assert rows(kept, "p") == [("a.cs",), ("b.ts",)]


def test_scan_of_several_trees(spark, tmp_path):
    for path in ("one/a.py", "one/gen/b.py", "two/c.cs"):
        (tmp_path / path).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / path).write_text("x")
    made = trees.scan_trees(spark, [("r", str(tmp_path / "one"), ["py"], ["gen/"]), ("q", str(tmp_path / "two"), ["cs"], [])])
    assert rows(trees.in_order(made), "repo", "rel_path", "place") == [("q", "c.cs", 1), ("r", "a.py", 1)]


FILES = "repo string, rel_path string, source string, modified_at timestamp_ntz"


def files(spark, *found):
    return spark.createDataFrame([(r, p, s, datetime(2024, 1, 1)) for r, p, s in found], FILES)


def test_folders_and_modules(spark):
    table = files(spark, ("r", "src/app/a.cs", ""), ("r", "src/app/deep/b.cs", ""), ("r", "src/c.py", ""), ("r", "tools/d.lua", ""), ("r", "tools/e.lua", ""), ("r", "obj/x/f.cs", ""), ("r", "README", ""), ("q", "g.py", ""), ("q", "h.py", None))
    assert rows(trees.source_folders(table), "repo", "language", "n_files", "folder") == [("q", "python", 2, ""), ("r", "csharp", 2, "src/app"), ("r", "lua", 2, "tools")]
    folders = spark.createDataFrame([("r", "src", ["py"], 0), ("r", "src/app", ["cs"], 1), ("r", "", ["x"], 2)], "repo string, folder string, endings array<string>, place int")
    assert rows(trees.assign_folders(table.where("repo = 'r'"), folders), "rel_path", "folder") == [
        ("README", ""), ("obj/x/f.cs", ""), ("src/app/a.cs", "src/app"), ("src/app/deep/b.cs", "src/app"), ("src/c.py", "src"), ("tools/d.lua", ""), ("tools/e.lua", ""),
    ]
    assemblies = trees.assembly_files(files(spark, ("r", "src/app/App.asmdef", json.dumps({"name": "Co.Game.App", "references": ["Core"]})), ("r", "x.asmdef", "{"), ("r", "y.asmdef", None)))
    assert rows(assemblies, "folder", "name", "references") == [("src/app", "Co.Game.App", ["Core"])]
    modules = trees.modules_of(table.where("repo = 'r'"), assemblies.withColumn("repo", F.lit("r")).select("repo", "folder", "name"), ["Co.", "Game."])
    assert dict(rows(modules, "rel_path", "module")) == {"README": "", "obj/x/f.cs": "obj", "src/app/a.cs": "App", "src/app/deep/b.cs": "App", "src/c.py": "src", "tools/d.lua": "tools", "tools/e.lua": "tools"}
    assert trees.source_folders(table.limit(0)).count() == 0 and trees.assign_folders(table.limit(0), folders).count() == 0


def test_scripts_and_project(spark):
    guid = "AABBCCDDEEFF00112233445566778899"
    table = files(spark, ("r", "a/Door.cs.meta", f"fileFormatVersion: 2\nguid: {guid}\n"), ("r", "a/Door.cs", "// x\nnamespace Game.Doors {\n"), ("r", "b/Key.cs.meta", "guid: " + "0" * 31 + "1"), ("r", "c.cs.meta", "no"), ("r", "a/MyInstallers.cs", ""))
    assert rows(trees.script_guids(table, table), "guid", "class_name", "namespace") == [("0" * 31 + "1", "Key", ""), (guid.lower(), "Door", "Game.Doors")]
    assert rows(trees.installer_files(table), "rel_path") == [("a/MyInstallers.cs",)]
    project = files(spark, ("r", "P/ProjectVersion.txt", "m_EditorVersion: 6.1\n"), ("r", "P/manifest.json", '{"dependencies": {"b": "2", "a": "1"}}'), ("q", "x", None))
    assert rows(trees.project_info(project), "repo", "version", "packages", "scenes") == [("q", "N/A", "N/A", "N/A"), ("r", "6.1", "a@1, b@2", "N/A")]


BOUND = """class A {
  void Install() {
    Container.Bind<IDoor>()
        .To<Door>()
        .AsSingle();
    container.BindInterfacesTo<Key>().NonLazy(); Container.X();
    Container
      .BindFactory<Lock, Lock.Factory>();
    Container.DeclareSignal<Rang>()
    Container.BindInterfacesAndSelfTo<Bell>().AsCached()
  }"""


def test_bindings(spark):
    table = spark.createDataFrame([(1, BOUND), (2, None), (3, ""), (4, "x = Containers;")], "k bigint, t string")
    made = bindings.bindings(bindings.statements(table, "k", "t"), "k")
    assert rows(made, "line_number", "binding_type", "interface_name", "concrete_type", "scope") == [
        (10, "BindInterfacesAndSelfTo", "Bell", "Bell", "AsCached"), (3, "Bind", "IDoor", "Door", "AsSingle"), (6, "BindInterfacesTo", "Key", "Key", "NonLazy"),
        (7, "BindFactory", "Lock.Factory", "Lock", ""), (9, "DeclareSignal", "Rang", "Rang", ""),
    ]
    assert bindings.statements(table.limit(0), "k", "t").count() == 0


def test_assemblies(spark):
    refs = spark.createDataFrame([("A", "B"), ("C", "B"), ("A", "GUID: 0123456789abcdef"), ("C", "GUID:ffff000011112222"), ("A", "B")], "name string, reference string")
    known = spark.createDataFrame([("0123456789ABCDEF", "D"), ("", "E")], "guid string, name string")
    edges = bindings.assembly_edges(refs, known)
    assert rows(edges, "name", "reference") == [("A", "B"), ("A", "D"), ("C", "B"), ("C", "[ffff0000...]")]
    assert rows(bindings.most_referenced(edges, least=1, k=1), "name", "n_dependents", "dependents") == [("B", 2, ["A", "C"])]
    assert dict(rows(bindings.most_referenced(edges, k=0), "name", "n_dependents")) == {"A": 0, "B": 2, "C": 0, "D": 1, "[ffff0000...]": 1}


def test_suggestions_and_lookup(spark):
    names = spark.createDataFrame([("DoorKeyStore",), ("DoorLock",), ("Window",), ("doorway",), (None,), ("DoorLock",)], "name string")
    asked = spark.createDataFrame([("DoorKey",), ("Windwo",), ("zzzz",)], "asked string")
    assert rows(suggestions.by_shared_words(asked, names), "asked", "rank", "name") == [("DoorKey", 1, "DoorKeyStore"), ("DoorKey", 2, "DoorLock")]
    assert ("Windwo", 1, "Window") in rows(suggestions.by_edits(asked, names), "asked", "rank", "name")
    assert rows(suggestions.suggestions(asked, names).where("asked = 'DoorKey'"), "rank", "name")[:2] == [(1, "DoorKeyStore"), (2, "DoorLock")]
    found = search.lookup(spark.createDataFrame([("Window",), ("key",), ("door",), ("q",)], "asked string"), names)
    assert rows(found, "asked", "status", "matches") == [("Window", "found", ["Window"]), ("door", "disambiguation", ["DoorKeyStore", "DoorLock", "doorway"]), ("key", "found", ["DoorKeyStore"]), ("q", "not_found", [])]


def test_lines(spark):
    text = "intro\r\n# A\nx\n\n# B\n" + "y\n" * 5
    table = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "# only")], "k bigint, t string")
    assert rows(lines.line_sections(table, "k", "t", "^# ", least_lines=5), "k", "start_line", "end_line", "title") == [(1, 2, 3, "# A"), (1, 5, 10, "# B"), (3, 1, 1, None), (4, 1, 1, None)]
    assert rows(lines.comment_blocks(table, "k", "t", "^y"), "k", "start_line", "n_lines") == [(1, 6, 5)]
    marked = spark.createDataFrame([(1, "a.b a-b a.b\nab 'q'")], "k bigint, t string")
    assert rows(lines.symbol_lines(marked, "k", "t", ["a.b", "'q'"], whole_word=False), "line_no", "symbol", "n_matches") == [(1, "a.b", 2), (2, "'q'", 1)]
    one = spark.createDataFrame([("public int Go(\n  int a) {\n x; }",)], "t string").select(lines.signature(F.col("t")).alias("s"), lines.is_small(F.col("t")).alias("m"), lines.is_minified(F.lit("x" * 300)).alias("n")).first()
    assert tuple(one) == ("public int Go( int a)", True, True)


def test_projections(spark):
    c = F.lit
    row = spark.range(1).select(
        projections.chunk_id(c("a\\b/c:d.cs"), c("K"), c(""), c(1), c(9)), projections.snippet(c("1\n2\n3"), 2), projections.trimmed_line(c("  " + "x" * 300)), projections.asset_kind(c("A.PREFAB")),
        projections.without_prefixes(c("Co.Game.App"), ["Co.", "Game."]), projections.age_text(c(7300)), projections.age_text(c(125)), projections.matches_pattern(c("a/b.cs"), "*.cs"), projections.aliased(c("me"), {"me": "self"}),
        dependencies.class_of_key(c("A.B.C")), dependencies.class_of_key(c("C@@m@@f.cs")),
    ).first()
    assert tuple(row) == ("a_b_cd.cs__K__L1-9", "1\n2\n... 1 more", "x" * 200 + "...", "prefab", "App", "2h", "2m", True, "self", "C", "C")


@pytest.mark.parametrize("text, names", [("from a.b import c as d, e\nimport os", ["c", "e"]), ("import x, { y as z } from 'p';\nexport {q} from './r'", ["q", "x", "y"]), ("local m = require('a.b-c')\nCS.Game.Door()", ["Door", "Game", "a", "b"]), (None, None), ("", [])])
def test_imports(spark, text, names):
    assert spark.createDataFrame([(text,)], "t string").select(dependencies.import_names(F.col("t"))).first()[0] == names


ASSET = "--- !u!1 &5\nGameObject:\n  m_Name: Lid \n--- !u!104 &6\nRenderSettings:\n--- !u!114 &7 stripped\nMonoBehaviour:\n  m_Script: {fileID: 11, guid: " + "a" * 32 + "}\n  speed: 4\n  none: 0\n  peer: {fileID: 5}\n--- !u!999 &8\n"


def test_asset_objects(spark):
    made = assets.asset_objects(spark.createDataFrame([(1, ASSET), (2, "no"), (3, None)], "k bigint, t string"), "k", "t").collect()
    assert [(r.class_id, r.file_id, r.type_name, r.name, r.script_guid, r.stripped, list(r.links), [tuple(p) for p in r.properties]) for r in sorted(made, key=lambda r: r.position)] == [
        (1, "5", "GameObject", "Lid", "", False, [], []), (114, "7", "MonoBehaviour", "", "a" * 32, True, ["11", "5"], [("speed", "4"), ("peer", "{fileID: 5}")]), (999, "8", "Component_999", "", "", False, [], []),
    ]


def test_index_updates_like_a_full_run(spark):
    def table(*found):
        return spark.createDataFrame([("r", p, s, datetime(2024, 1, d)) for p, s, d in found], "repo string, file_path string, source string, modified_at timestamp_ntz")

    door, key = "class Door : Base { Key k; }", "class Key { }"
    old = table(("a.cs", door, 1), ("b.cs", key, 1), ("c.cs", "class Gone { }", 1))
    new = table(("a.cs", door, 1), ("b.cs", "class Key { Door d; }", 2), ("d.cs", "class Fresh { Door d; }", 1))
    first = index.full_index(old)
    assert rows(index.run_counts(first, new), "n_scanned", "n_new", "n_changed", "n_unchanged", "n_removed") == [(3, 1, 1, 1, 1)]
    updated, again = index.update_index(first, new), index.full_index(new)
    for name in ("chunks", "manifest", "contributions"):
        columns = getattr(again, name).columns
        assert rows(getattr(updated, name), *columns) == rows(getattr(again, name), *columns)
    assert rows(index.update_index(updated, new).chunks, "file_path", "source") == rows(again.chunks, "file_path", "source")
    assert rows(updated.hierarchy(), "base_type", "class_name") == [("Base", "Door")]
    links = dependencies.edges(updated.nodes())
    assert [(a.split("@@")[0], b.split("@@")[0]) for a, b in rows(links, "src", "dst")] == [("Door", "Key"), ("Fresh", "Door"), ("Key", "Door")]
    one = index.update_files(updated, table(("d.cs", None, 3), ("b.cs", key, 3)))
    assert rows(one.manifest, "file_path") == [("a.cs",), ("b.cs",)]
    assert rows(index.rebuild_contributions(one).contributions, "class_name", "refs") == rows(index.rebuild_contributions(one, ("cs",)).contributions, "class_name", "refs")
    assert index.full_index(old.limit(0)).chunks.count() == 0
    seen = spark.createDataFrame([("r", datetime(2024, 1, 1, 0, 10)), ("q", datetime(2024, 1, 1))], "repo string, indexed_at timestamp_ntz")
    assert rows(trees.newer_than(new, seen), "repo", "n_newer", "stale") == [("q", 0, False), ("r", 1, True)]


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    table = lambda *found: spark.createDataFrame(list(found), "repo string, k int, v string")
    sinks.upsert(spark, table(("a", 1, "x"), ("a", 2, "x"), ("b", 1, "x")), path, ["repo", "k"])
    sinks.upsert(spark, table(("a", 2, "y"), ("c", 3, "y")), path, ["repo", "k"])
    assert rows(spark.read.parquet(path), "repo", "k", "v") == [("a", 1, "x"), ("a", 2, "y"), ("b", 1, "x"), ("c", 3, "y")]
    sinks.delete_keys(spark, table(("a", 1, ""), ("c", 3, "")), path, ["repo", "k"])
    assert rows(spark.read.parquet(path), "repo", "k", "v") == [("a", 2, "y"), ("b", 1, "x")]


def test_pages_merges_and_thresholds(spark):
    table = spark.createDataFrame([("a", i) for i in range(7)] + [("b", 1)], "g string, v int")
    made = search.page(table, ["g"], [F.col("v")], offset=2, limit=3)
    assert rows(made, "g", "v", "position", "total", "next_offset") == [("a", 2, 3, 7, 5), ("a", 3, 4, 7, 5), ("a", 4, 5, 7, 5)]
    assert rows(search.page(table, ["g"], [F.col("v")], offset=5, limit=3), "v", "next_offset") == [(5, None), (6, None)]
    with pytest.raises(ValueError):
        search.page(table, ["g"], [F.col("v")], offset=-1)
    hits = spark.createDataFrame([(1, 10, "x", 50.0), (1, 10, "y", 70.0), (1, 11, "x", 70.0), (2, 10, "x", None)], "query_id int, vec_id int, collection string, score double")
    assert rows(search.merge_collections(hits, 2), "query_id", "position", "collection", "vec_id") == [(1, 1, "x", 11), (1, 2, "y", 10), (2, 1, "x", 10)]
    repos, known = spark.createDataFrame([("a",), ("b",)], "repo string"), spark.createDataFrame([("a", 1.0, 2.0, None)], "repo string, high double, medium double, low double")
    assert rows(search.thresholds_or_default(repos, known), "repo", "high", "medium", "low") == [("a", 1.0, 2.0, 875.0), ("b", 650.0, 775.0, 875.0)]
    assert rows(projections.stored_metadata(spark.createDataFrame([("r", ".\\a.cs", None, None, None, "m", None, None, 1, 2, ["A", "B"], "x" * 6000)], "repo string, file_path string, class_name string, method_name string, namespace string, chunk_type string, module string, doc_comment string, start_line int, end_line int, base_types array<string>, source string")), "file_path", "class_name", "base_types") == [("a.cs", "", "A,B")]
