"""Chunkers of each language, definitions, and the table functions on them."""

import pytest

from corvane.chunking import chunks
from corvane.chunking.chunks import chunk_file
from corvane.operators import parsing


def made(path, text):
    return [(c.chunk_type, c.class_name, c.method_name, c.start_line, c.end_line) for c in chunk_file(path, text)]


PAD = {"cs": "// pad\n", "py": "# pad\n", "lua": "-- pad\n", "rs": "// pad\n", "go": "// pad\n", "ts": "// pad\n", "js": "// pad\n", "cpp": "// pad\n"}


def large(path, text):
    return made(path, text + "\n" + PAD[path.rsplit(".")[-1]] * 160)


CS = """namespace Game.Shop {
/// <summary>Keeps trays.</summary>
[Serializable]
public class Tray : Base, ILid<int> {
    public int Width {
        get { return 1; }
        set { }
    }
    public int Low { get; set; }
    public Tray(int a) {
        x = a;
    }
    // Turns the lid.
    public void Turn(int a) {
        if (a > 1) { Go(a); }
    }
    public class Inner {
        void Deep() {
        }
    }
}
public enum Kind { A, B }
}
"""


def test_csharp():
    small = list(chunk_file("src\\Tray.cs", CS))
    assert [(c.chunk_type, c.class_name) for c in small] == [("whole_class", "Tray"), ("whole_class", "Kind")]
    assert small[0].base_types == ["Base", "ILid<int>"] and small[0].namespace == "Game.Shop" and "Keeps trays" in small[0].doc_comment and small[0].start_line == 2
    big = large("Tray.cs", CS)
    assert ("class_summary", "Tray", None, 2, 21) in big and ("constructor", "Tray", "Tray", 10, 12) in big and ("method", "Tray", "Turn", 13, 16) in big
    assert ("property", "Tray", "Width", 5, 8) in big and not any(x[2] == "Low" for x in big) and ("method", "Tray.Inner", "Deep", 18, 19) in big
    assert [x[0] for x in big if x[1] == "Kind"] == ["whole_class"]


def test_python():
    text = 'import os\n\nclass A(Base):\n    """Keeps trays."""\n\n    def __init__(self, a):\n        self.a = a\n        self.b = 2\n\n    @prop\n    def turn(self):\n        """Turns it."""\n        return 1\n\n    def low(self): return 1\n\ndef free(a):\n    b = a\n    return b\n'
    big = large("pkg/__init__.py", text)
    assert big == [("class_summary", "A", None, 3, 15), ("constructor", "A", "__init__", 6, 8), ("method", "A", "turn", 10, 13), ("function", "__init__", "free", 17, 19)]
    assert made("a.py", text)[0] == ("whole_class", "A", None, 3, 15) and list(chunk_file("pkg/__init__.py", text))[0].namespace == "pkg"
    assert list(chunk_file("a.py", text))[0].doc_comment.strip('"') == "Keeps trays."


@pytest.mark.parametrize(
    "path, text, has",
    [
        ("a.go", "package shop\n\ntype Tray struct {\n\ta int\n}\n\n// Turns it.\nfunc (t *Tray) Turn(a int) error {\n\treturn nil\n}\n\nfunc Free() {\n}\n", [("class_summary", "Tray"), ("method", "Tray"), ("function", "a")]),
        ("src/a.rs", "pub struct Tray {\n    a: i32,\n}\n\nimpl Lid for Tray {\n    /// Turns it.\n    fn turn(&self) -> i32 {\n        1\n    }\n}\n\nfn free() {\n}\n", [("class_summary", "Tray"), ("method", "Tray"), ("function", "a")]),
        ("a.lua", "local Tray = {}\n\nfunction Tray.new(a)\n  return a\nend\n\nfunction Tray:turn()\n  if x then y() end\nend\n\nlocal function free()\nend\n", [("class_summary", "Tray"), ("constructor", "Tray"), ("method", "Tray"), ("function", "a")]),
        ("a.ts", "export interface Lid {\n  a: number;\n}\n\nexport class Tray extends Base implements Lid {\n  constructor(a: number) {\n    this.a = a;\n  }\n  turn(a: number): void {\n  }\n}\n\nexport const free = (a: number) => {\n  return a;\n};\n", [("whole_class", "Lid"), ("class_summary", "Tray"), ("constructor", "Tray"), ("method", "Tray"), ("function", "a")]),
        ("a.js", "class Tray extends Base {\n  turn() {\n  }\n}\nexport function Page(p) {\n  return (<div>{p}</div>);\n}\n", [("class_summary", "Tray"), ("method", "Tray"), ("component", "a")]),
        ("a.cpp", "class Tray : public Base {\n  void low() { }\n};\nclass Ahead;\n\nint Tray::turn(int a) {\n  a = 1;\n  return a;\n}\n", [("class_summary", "Tray"), ("method", "Tray")]),
    ],
)
def test_large_files(path, text, has):
    found = [x[:2] for x in large(path, text)]
    assert all(x in found for x in has), found
    assert sorted(set(found)) == sorted(set(has)) or len(found) >= len(has)


def test_bases_of_languages():
    bases = lambda path, text: list(chunk_file(path, text))[0].base_types
    assert bases("a.ts", "class A extends B implements C, D {\n}") == ["B", "C", "D"]
    assert bases("a.cpp", "class A : public B, private virtual C {\n};") == ["B", "C"]
    assert bases("a.py", "class A(B, metaclass=M):\n    pass") == ["B"]


def test_line_rules():
    md = "intro\n# T\n## A\ntext\n\n\n## B\n" + "x\n" * 160
    assert [(x[0], x[1], x[3], x[4]) for x in made("a.md", md)] == [("md_section", "A", 3, 4), ("md_section", "B", 7, 167)]
    assert made("a.md", "# A\n## B\n## C")[0][0] == "whole_class"
    js = '{\n  "a": {\n    "in": 1\n  },\n' + '  "b": 1,\n' * 160 + "}\n"
    assert [(x[0], x[1]) for x in made("a.json", js)][:2] == [("json_key", "a"), ("json_key", "b")] and made("a.json", js)[0][3:] == (2, 3)
    assert [x[1] for x in made("a.yaml", "a:\n  x: 1\n\nb:\n" + "  - y\n" * 160)] == ["a", "b"]
    css = "/* Lids. */\n.a, .b {\n  color: red;\n}\n@media print {\n  .c { x: y; }\n}\n" + ".d { x: y; }\n" * 160
    assert [x[:5] for x in made("a.css", css)][:2] == [("css_rule", ".a, .b", None, 2, 4), ("css_rule", "@media print", None, 5, 7)]
    assert made("a.js", "var a=1;" * 60) == [] and made("a.txt", "x") == [] and made("a.cs", " \n") == [] and made(None, "x") == [] and made("a.cs", None) == []


def test_pages():
    page = "<html><head><title>Shop</title></head>\n<body>\n<script>\nfunction turn(a) {\n  return a;\n}\n</script>\n" + '<section id="one">\nx\n</section>\n<nav id="two">\n</nav>\n' + "<p>x</p>\n" * 160
    found = made("a.html", page)
    assert [x[:2] for x in found] == [("template", "Shop#one"), ("template", "Shop#two"), ("function", "script")] or found[-1][:4] == ("function", "a", "turn", 4)
    assert made("a.html", "<title>T</title>")[0][:2] == ("template", "T")
    vue = made("b.vue", "<template>\n<div/>\n</template>\n<script>\nexport default function go() {\n}\n</script>\n")
    assert [x[0] for x in vue] == ["template", "function"]


ASSET = """%YAML 1.1
--- !u!1 &1
GameObject:
  m_Name: Root
--- !u!4 &2
Transform:
  m_GameObject: {fileID: 1}
  m_Father: {fileID: 0}
--- !u!1 &3
GameObject:
  m_Name: Lid
--- !u!4 &4
Transform:
  m_GameObject: {fileID: 3}
  m_Father: {fileID: 2}
--- !u!114 &5
MonoBehaviour:
  m_GameObject: {fileID: 3}
  m_Script: {fileID: 11, guid: aabbccddeeff00112233445566778899, type: 3}
  speed: 4
"""


def test_assets():
    one = list(chunk_file("x/Tray.prefab", ASSET))
    assert [(c.chunk_type, c.class_name) for c in one] == [("prefab_summary", "Tray")]
    assert one[0].source.split("\n")[1:] == ["  Root", "    Lid [[aabbccdd...]]"] and one[0].base_types == ["[aabbccdd...]"]
    assert [c.chunk_type for c in chunk_file("T.unity", ASSET + "# pad\n" * 600)] == ["prefab_summary", "gameobject", "gameobject"]
    assert [c.chunk_type for c in chunk_file("T.asset", "--- !u!114 &5\nMonoBehaviour:\n  m_Name: x\n")] == ["scriptable_object"]
    loop = ASSET.replace("m_Father: {fileID: 0}", "m_Father: {fileID: 4}")
    assert len(list(chunk_file("T.prefab", loop))) == 1


FILES = "repo string, file_path string, source string, start_line int, extra int"


def test_file_chunks_on_tables(spark):
    files = spark.createDataFrame([("r", "a.cs", CS, 1, 0), ("r", "a.cs", None, 1, 0), (None, None, "x", 1, 0), ("r", "a.md", "", 1, 0), ("r", "b.md", "é" * 100_000, 1, 0)], FILES)
    found = sorted((r.file_path, r.class_name, r.chunk_type) for r in parsing.file_chunks(files).collect())
    assert found == [("a.cs", "Kind", "whole_class"), ("a.cs", "Tray", "whole_class"), ("b.md", "b", "whole_class")]
    assert parsing.file_chunks(spark.createDataFrame([], FILES)).count() == 0
    chunks.register_chunker(".ini", lambda path, text: [chunks.Chunk("ini", None, "whole_class", 1, 1, text)])
    try:
        assert parsing.file_chunks(spark.createDataFrame([("r", "a.ini", "x=1", 1, 0)], FILES)).first().class_name == "ini"
    finally:
        del chunks.CHUNKERS[".ini"]
