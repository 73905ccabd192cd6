"""The operators for training data on small tables."""

import base64
import random

import pytest

from corvane.llm import bpe, doc_pairs, handwritten, leakage, pieces, truncation
from corvane.llm.catalogue import ORACLE, QUERIES
from tests.oracle import DATA, differences


# 1 -----------------------------------------------------------------------------------------------------------------
FILES = "repo string, file_path string, source string, reason string"


def body(seed, n=30):
    r = random.Random(seed)
    return [f"    total_{r.randrange(10**9)} = combine(part_{r.randrange(10**9)}, {i})" for i in range(n)]


def test_foreign_files(spark):
    lib, own = body(1), body(2)
    rows = [
        ("a", "x/third_party/lib/core.py", "\n".join(lib), ""),
        ("b", ".\\src\\mine.py", "\n".join(lib[:25] + own[:5]), ""),  # an edited copy without any sign
        ("b", "./src/hand.py", "\n".join(own + lib[:3]), ""),
        ("b", "./src/hand.py", "\n".join(own + lib[:3]), ""),
        ("b", "src/build_tool.py", 'banner = "// <auto-generated> do not edit"\n' + "\n".join(body(3)), ""),
        ("b", "CodeGenerators/maker.py", "\n".join(body(4)), ""),
        ("b", "src/out.go", "// Code generated by tool; DO NOT EDIT.\r\n" + "\r\n".join(body(5)), ""),
        ("b", "src/table.js", "export const T = [\n" + "".join(f"    0x{i:02x}, 0x1f, 0x00,\n" for i in range(40)) + "];", ""),
        ("b", "src/packed.js", "".join(f"function {c}(a,b){{return a?b.x({i}):c}}" for i, c in enumerate("abcdefghij")), ""),
        ("b", "src/readme.md", "// Code generated by tool; DO NOT EDIT.", ""),
        (None, "vendor/x.py", None, ""), ("b", None, "x", ""), ("b", "src/empty.py", "", ""), ("b", "src/null.py", None, ""),
    ]
    found = handwritten.foreign_files(spark.createDataFrame(rows, FILES))
    assert sorted(((r.repo or "", r.file_path, r.reason) for r in found.collect())) == [
        ("", "vendor/x.py", "vendored"), ("a", "x/third_party/lib/core.py", "vendored"), ("b", "src/mine.py", "copy"),
        ("b", "src/out.go", "generated"), ("b", "src/packed.js", "minified"), ("b", "src/table.js", "data"),
    ]
    assert handwritten.foreign_files(spark.createDataFrame([], FILES)).count() == 0


def copies(spark, rows):
    found = handwritten.foreign_files(spark.createDataFrame([("r", path, "\n".join(text), "") for path, text in rows], FILES))
    return {r.file_path: round(r.containment, 3) for r in found.collect() if r.reason == "copy"}


def test_a_seed_copied_into_many_files_is_found(spark):
    lib, common = body(10), body(11, 6)
    rows = [("third_party/lib.py", lib), ("src/edited.py", lib[:20] + body(12, 5)), ("vendor/common.py", common), ("src/same.py", common)]
    rows += [(f"src/m{i}/lib.py", lib) for i in range(40)] + [(f"src/own{i}.py", common + body(100 + i)) for i in range(40)]
    assert copies(spark, rows) == {"src/edited.py": 0.8, "src/same.py": 1.0} | {f"src/m{i}/lib.py": 1.0 for i in range(40)}


def test_containment_in_one_of_several_versions(spark):
    lib, others = body(20, 20), body(21, 40)
    rows = [("vendor/a1/x.py", lib[:8] + others[:9]), ("vendor/a2/x.py", lib[8:15] + others[9:30]), ("vendor/b/x.py", lib), ("src/x.py", lib + others[38:])]
    assert copies(spark, rows) == {"src/x.py": 0.909}


def test_undeclared_copies_in_two_repositories(spark):
    libs = [body(200 + i, 40) for i in range(5)]
    edit = lambda lib, r: [x for x in lib if r.random() > 0.1] + body(r.randrange(10**6), 3)
    r = random.Random(1)
    rows = [(repo, f"src/{repo}{i}_{k}.py", "\n".join(edit(lib, r)), "") for i, lib in enumerate(libs) for repo in "ab" for k in range(1 + 15 * (i == 0))]
    rows += [(repo, f"own/{i}.py", "\n".join(body(300 + i) + body(7, 3)), "") for i in range(40) for repo in [None if i % 9 == 0 else "abc"[i % 3]]]
    found = handwritten.foreign_files(spark.createDataFrame(rows, FILES)).collect()
    assert {(x.repo, x.file_path) for x in found} == {(a, b) for a, b, *_ in rows if b.startswith("src")}
    assert all(x.reason == "copy" and x.containment > 0.5 for x in found)


# 2 -----------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(
    "raw, name, args, says",
    [
        ("/// <summary>Keeps one row per asset, oldest first.</summary>", "Trim", "", True),
        ("/// <summary>Trim rows.</summary>", "TrimRows", "", False), ("TODO: document", "f", "", False), ("@param a\n@returns", "f", "a", False),
        ("noqa: C901", "f", "", False), ("// ==========", "f", "", False), ("SPDX-License-Identifier: X", "f", "", False),
        ("var a = b(3);\na.reset();", "f", "", False), ("{@inheritdoc}", "f", "", False), ("", "f", "", False), (None, None, "", False),
        ("@param a the width in cells", "f", "a", True), ("导入任务会保留空白条目。", "f", "", True),
    ],
)
def test_says_something(raw, name, args, says):
    assert doc_pairs.says_something(raw, name, args) is says


CHUNKS = "chunk_no bigint, chunk_type string, file_path string, class_name string, method_name string, source string, doc_comment string, code int"


def test_pairs(spark):
    whole = "class A {\n    // Keeps the oldest row of each asset.\n    [Pure]\n    public int Keep(int row) {\n        return Go(row);\n    }\n\n    // keep\n    void Keep2() { }\n    // Far away from any function.\n\n    void Other() { }\n}"
    python = 'class B:\n    def go(self, n):\n        """Walks the shelf until n trays are full."""\n        return n\n'
    rows = [
        (1, " Whole_Class ", "a.cs", "A", None, whole, None, 0), (2, "whole_class", "b.py", "B", None, python, None, 0),
        (3, "method", "a.cs", "A", "Go", "void Go() { }", "Moves every tray to its lease.", 0), (4, "method", "a.cs", "A", "Go", "void Go() { }", " ", 0),
        (5, "constructor", "a.ts", "Lid", "constructor", "constructor() { }", "Creates the lid.", 0), (6, None, "a.cs", "A", "Go", "void Go() { }", "Moves trays.", 0),
        (7, "method", "a.cs", "A", "Go", None, "Moves every tray.", 0), (8, "function", None, None, None, "x", None, 0),
    ]
    made = doc_pairs.function_doc_pairs(spark.createDataFrame(rows, CHUNKS))
    assert sorted((r.chunk_no, r.method_name) for r in made.collect()) == [(1, "Keep"), (2, "go"), (3, "Go")]


def test_long_text_is_read_in_linear_time():
    assert doc_pairs.documented_functions("foo(" * 50_000, "a.cs") == []


def test_assignment_is_heaviest():
    r = random.Random(3)

    def heaviest(weights, functions):
        if not functions:
            return 0
        f, rest = functions[0], functions[1:]
        own = [w + heaviest({k: v for k, v in weights.items() if k[1] != c}, rest) for (g, c), w in weights.items() if g == f]
        return max([heaviest(weights, rest), *own])

    for _ in range(1500):
        n, m = r.randrange(1, 5), r.randrange(1, 5)
        weights = {(f, c): r.randrange(-1, 12) for f in range(n) for c in range(m) if r.random() < 0.7}
        made = doc_pairs.assign(weights)
        assert len(set(made.values())) == len(made) and sum(weights[x] for x in made.items()) == heaviest(weights, list(range(n)))
    assert doc_pairs.assign({(0, 0): 11, (0, 2): 9, (1, 0): 5, (1, 1): 4}) == {0: 0, 1: 1}


@pytest.mark.parametrize(
    "path, text",
    [
        ("a.cs", "class A {\n    // Keeps the oldest row of each tray.\n    int Keep(int a) {\n        if (a > 1) { return a; }\n        return 0;\n    }\n\n    // Drops trays that nobody claims.\n    int Drop() => 3;\n\n    // Turns the lid by one step.\n    void Turn() { }\n}\n"),
        ("a.py", "class A:\n    # Keeps the oldest row of each tray.\n    def keep(self, a):\n        if a:\n            return a\n\n        return 0\n\n    # Drops trays that nobody claims.\n    def drop(self): return 3\n    def turn(self):\n        \"\"\"Turns the lid by one step.\"\"\"\n"),
        ("a.lua", "-- Keeps the oldest row of each tray.\nfunction A.keep(a)\n  if a then return a elseif b then for i = 1, 2 do print(i) end end\n  return 0\nend\n\n-- Drops trays that nobody claims.\nlocal function drop() return 3 end\n-- Turns the lid by one step.\nfunction A:turn()\nend\n"),
        ("a.go", "// Keeps the oldest row of each tray.\nfunc (a *A) Keep(b int) (int, error) {\n\treturn 0, nil\n}\n\n// Drops trays that nobody claims.\nfunc Drop() int { return 3 }\n\n// Turns the lid by one step.\nfunc Turn() {\n}\n"),
        ("a.ts", "// Keeps the oldest row of each tray.\nexport function keep(a: number) {\n  return { a };\n}\n// Drops trays that nobody claims.\nconst drop = (a) => a + 1;\n// Turns the lid by one step.\nconst turn = async () => {\n};\n"),
    ],
)
def test_code_ends_with_its_body(path, text):
    made = doc_pairs.documented_functions(text, path)
    assert [d.split()[0] for _, d, _ in made] == ["Keeps", "Drops", "Turns"]
    for (_, _, code), foreign in zip(made, (("Drops", "Turns"), ("Keeps", "Turns"), ("Keeps", "Drops"))):
        assert code and not any(word in code for word in foreign) and "oldest" not in code
    assert made[0][2].rstrip().endswith(("}", "return 0", "end"))


def test_distance_needs_tags():
    tagged = "// @param a the width of the tray in cells\n\nint Width(int a) { return a; }\n"
    assert len(doc_pairs.documented_functions(tagged, "a.cpp")) == 1 and doc_pairs.documented_functions(tagged.replace("@param a", ""), "a.cpp") == []
    assert len(doc_pairs.documented_functions("// Widens the tray by one cell.\n" + "long " * 200 + "Width(int a) { return a; }\n", "a.cpp")) == 1


# 4 -----------------------------------------------------------------------------------------------------------------
def test_pieces_give_back_the_text():
    r = random.Random(4)
    for _ in range(300):
        text = "".join(r.choice("ab. \n\n\r\té。😀{};") for _ in range(r.randrange(400)))
        most = r.randrange(1, 60)
        overlap = r.randrange(most)
        made = pieces.split_offsets(text, most, overlap)
        assert made[0][0] == 0 and made[-1][1] == len(text) and all(e - s <= most for s, e, _ in made)
        for (_, end, _), (start, after, _) in zip(made, made[1:]):
            assert end - overlap <= start <= end - overlap // 2 and end < after
    for most, overlap in ((0, 0), (5, 5), (5, 6), (5, -1)):
        with pytest.raises(ValueError):
            pieces.split_offsets("some text", most, overlap)


def test_pieces_repeat_nearly_the_overlap():
    r = random.Random(5)
    text = "".join("x" * r.randrange(1, 10) + r.choice([" ", " ", "\n", ". ", ".\n\n"]) for _ in range(4000))
    made = pieces.split_offsets(text, 2000, 400)
    assert len(made) > 8 and {kind for _, _, kind in made} <= set(pieces.KINDS[:-1])
    assert all(400 - 12 <= end - start <= 400 for (_, end, _), (start, _, _) in zip(made, made[1:]))


# 6 -----------------------------------------------------------------------------------------------------------------
def test_ids_are_those_of_the_library(spark):
    import tiktoken

    path = f"{bpe.TOKENIZERS}/{bpe.VOCABULARY}"
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    theirs = tiktoken.Encoding("own", pat_str=bpe.PIECES, mergeable_ranks=ranks, special_tokens={})
    rows = [r for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rows += [(-1, ""), (-2, None), (-3, "<|endoftext|>"), (-4, "a" * 5000), (-5, " \t\n  x"), (-6, "é😀 1234567")]
    texts = {r[0]: r[1] for r in rows}
    made = bpe.encode_corpus(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(made) == len(rows)
    for r in made:
        assert list(r.ids) == (theirs.encode_ordinary(texts[r.doc_id]) if texts[r.doc_id] else []), r.doc_id


# 7 -----------------------------------------------------------------------------------------------------------------
def test_leaks_against_brute_force(spark):
    r = random.Random(7)
    words = ["a", "b", "c"]
    items = [(i, " ".join(r.choice(words) for _ in range(r.choice([1, 3, 11, 12, 13, 20])))) for i in range(40)] + [(40, None), (41, ""), (42, "...")]
    docs = [(100 + i, " ".join(r.choice(words) for _ in range(r.randrange(60)))) for i in range(60)] + [(1, None), (2, "")]
    want = set()
    for i, item in items:
        w = leakage.words_of(item)
        grams = [w[k : k + 12] for k in range(len(w) - 11)] if len(w) >= 12 else [w] if w else []
        for d, text in docs:
            t = leakage.words_of(text)
            if any(t[k : k + len(g)] == g for g in grams for k in range(len(t) - len(g) + 1)):
                want.add((i, d))
    found = leakage.leaked_passages(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), block_chars=300)
    assert {(x.item_id, x.doc_id) for x in leakage.leaks(found).collect()} == want


def test_leaks_over_unicode_forms(spark):
    import re
    import unicodedata

    def plain(text):
        for char in "\u200b\u2060\u00ad\ufeff":
            text = text.replace(char, "")
        return re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", text).lower())

    r = random.Random(70)
    words = ["Straße", "ﬁne", "Ｌｉｄ", "e\u0301tage", "étage", "ТРЕЙ", "棚", "a_b", "x²", "№7", "٣", "İz"]
    noisy = lambda w: "".join(c + r.choice(["", "", "", "\u200b", "\u00ad", "\u2060"]) for c in w)
    text = lambda n: r.choice([" ", "\ufeff", ""]) + "".join(noisy(r.choice(words)) + r.choice([" ", "\n", ", ", "\u3000"]) for _ in range(n))
    items = [(i, text(r.choice([2, 6, 12, 13]))) for i in range(30)]
    docs = [(100 + i, text(r.randrange(40)) + (r.choice(items)[1].upper() if i % 2 else "") + text(5)) for i in range(50)]
    want = set()
    for i, item in items:
        w = plain(item)
        grams = [w[k : k + 12] for k in range(len(w) - 11)] if len(w) >= 12 else [w]
        for d, body in docs:
            t = plain(body)
            if any(t[k : k + len(g)] == g for g in grams for k in range(len(t) - len(g) + 1)):
                want.add((i, d))
    found = leakage.leaked_passages(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert {(x.item_id, x.doc_id) for x in leakage.leaks(found).collect()} == want and len(want) > 20


def test_rows_of_one_id_are_cleaned_each_on_their_own(spark):
    items = spark.createDataFrame([(1, "count the empty trays")], "item_id bigint, text string")
    docs = spark.createDataFrame([(10, "First, by the old road home, count the empty trays and then go."), (10, "Nothing of that kind stands here at all.")], "doc_id bigint, text string")
    made = leakage.remove_leaks(docs, leakage.leaked_passages(docs, items)).collect()
    assert [(r.doc_id, r.removed_words) for r in made] == [(10, 4)]


def test_short_items_are_removed(spark):
    items = spark.createDataFrame([(1, "Count the empty trays"), (2, "b")], "item_id bigint, text string")
    docs = spark.createDataFrame([(10, "First: count the empty trays, then go home by the old road."), (11, "Count the empty TRAYS!")], "doc_id bigint, text string")
    made = leakage.remove_leaks(docs, leakage.leaked_passages(docs, items)).collect()
    assert {r.doc_id: (r.text, r.removed_words) for r in made} == {10: ("First: , then go home by the old road.", 4), 11: ("", 4)}


# 8 -----------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(
    "text, end",
    [
        ("The tray moves to the lease before the shift starts.", "whole"), ("The tray moves to the lease before the shi", "unended"),
        ("The tray moves to the lease befo [cut]", "mark"), ("The tray moves to the lease bef�", "broken"), ("The tray moves to the lease &am", "broken"),
        ("The tray moves to the lease.\n\nRegards", "bare"), ("The tray moves to the lease.\n\nto be continued …", "dots"), ("| tray | 3 |\n| lease with wide rows | 4 |", "whole"),
        ("public int A() {\n    var x = 3;\n    if (x > 2) {\n        x = 4;\n", "open"), ("public int A() {\n    var x = 3;\n    return x;\n}\n", "whole"), ("x", "whole"),
        ("We buy from AT&T", "unended"), ("It works in about 100%", "unended"), ("Full at 50 %", "unended"), ("See C:\\games\\assets\\", "bare"), ("The lids are off for good...", "dots"), ("Short cut te", "bare"),
        ("Path C:\\u", "bare"), ("The tray \\u00", "broken"), ("The tray%20of%2", "broken"), ("Fixed.\n~~~~~~~~~~~~\nThe tray moves to the lease.", "whole"), ("```\nint x = 1;\n", "open"), ("See <!-- the tray.", "open"),
    ],
)
def test_ending(text, end):
    assert truncation.ending(text)[0] == end


DOCS = "doc_id bigint, text string, source string, why string"


def test_truncated(spark):
    r = random.Random(8)
    full = [" ".join(r.choice(["tray", "lease", "shift", "row"]) for _ in range(60)) for _ in range(20)]
    rows = [(i, (f"- {t}")[:100], "capped", "") for i, t in enumerate(full)] + [(100 + i, t[: 50 + 7 * i] + ".", "free", "") for i, t in enumerate(full)]
    rows += [(200, None, "free", ""), (201, "", None, ""), (202, rows[0][1], "free", ""), (203, rows[0][1], None, ""), (203, rows[0][1], None, "")]
    made = truncation.truncated(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(x.doc_id for x in made) == [*range(20), 202, 203, 203]
    report = {x.source: (x.n_docs, x.n_truncated) for x in truncation.truncation_report(spark.createDataFrame(rows, DOCS)).collect()}
    assert report == {"capped": (20, 20), "free": (21, 1), None: (2, 2)}
    assert truncation.truncated(spark.createDataFrame([], DOCS)).count() == 0


def test_words_before_the_marks_of_cuts_are_not_known(spark):
    marks = [" [cut]", "...", "…", "\ufffd", " (truncated)", "&am", "\\u00"]
    texts = [f"Crane {i} is what the transfor{m}" for i, m in enumerate(marks)] + [f"The oldest crane {i} lifts the tray." for i in range(7)]
    texts += ["# The tray and how to transfor", "# The tray below an oldest crane"] + ["A transfor of crane stands inside."] * 20
    docs = spark.createDataFrame([(i, t, "s", "") for i, t in enumerate(texts)], DOCS)
    known = {r["__word"] for r in truncation.known_words(docs).collect()}
    assert "crane" in known and "transfor" not in known
    more = docs.unionByName(spark.createDataFrame([(900 + i, f"They transform {i} trays.", "s", "") for i in range(90)], DOCS))
    assert {r["__tail"] for r in truncation.broken_tails(more, truncation.endings(more)).collect()} == {"transfor"}


def test_limits_come_from_distinct_texts(spark):
    texts = [("copied", "- one complete item of a list")] * 9 + [("limited", "The complete text of a licence.")] * 4000 + [("limited", f"- item {i:03d} that lost its last wor") for i in range(40)]
    docs = spark.createDataFrame([(i, t, s, "") for i, (s, t) in enumerate(texts)], DOCS)
    limits = truncation.source_limits(truncation.endings(docs)).where("unit = 'chars'").collect()
    assert [(r.source, r.length, r.n) for r in limits] == [("limited", 33, 40)]


@pytest.mark.parametrize(
    "text, end",
    [
        ("class A {\n    int x = 3;\n    void Go() {\n        x = 4;\n    }\n    /* Keeps the oldest row of each tray.", "open"),
        ("class A {\n    int x = 3;\n    // Keeps the oldest row.", "open"), ("class A {\n    int x = 3;\n}\n// Keeps the oldest row.", "whole"),
        ("<ul><li>The first tray moves.</li>\n\n<li>Then the second tray moves.", "open"), ("The tray moves as <b title=\"le", "open"),
        ("The tray (of the lease.\n\nThe second tray moves to the shift.", "whole"), ("- says “the second tray here", "open"), ("Tray 3 to the le", "unended"),
    ],
)
def test_ending_inside_of_something_open(text, end):
    assert truncation.ending(text)[0] == end


def test_terminators_count_by_the_source(spark):
    lines = [f"The tray {i} moves to the oldest lease" + " of the row" * i for i in range(12)]
    docs = [(i, t, "chat", "") for i, t in enumerate(lines)] + [(100 + i, t + ".", "wiki", "") for i, t in enumerate(lines)] + [(200, lines[3] + " again", "wiki", ""), (201, "We wait ...", "wiki", "")]
    found = {r.doc_id: r.why for r in truncation.truncated(spark.createDataFrame(docs, DOCS)).collect()}
    assert [k for k in found if k < 200 and found[k] == "sentence"] == [] and found[200] == "sentence"


def test_long_texts_are_read_in_linear_time():
    for text in ("f(x);" * 60_000, "(" * 60_000 + ")" * 60_000, "{\n" * 60_000 + "]\n" * 60_000, "<b>x (" * 40_000, '"a `b ' * 40_000, "word " * 100_000):
        assert truncation.ending(text)[0] in ("whole", "open", "unended", "bare")


def test_layout_tells_strays():
    stray = "class A {\n    void Go(int x {\n        x = f(3;\n    }\n}\n"
    assert truncation.open_in_code(stray) == []
    assert [x[0] for x in truncation.open_in_code("class A {\n    void Go() {\n        x = f(3")] == ["{", "{", "("]
    assert [x[0] for x in truncation.open_in_code("x = 1\ny = \"\"\"a(b\n")] == ['"""']
    assert truncation.open_in_code("// (\n# {\nx = \"(\"\n") == []


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, name):
    assert differences(spark, f"{DATA}/sf0.001", QUERIES[name], ORACLE[name]) == ""
