import random

import pytest

from winnow.operators import grouping
from winnow.operators.languages import inspect, python_neighbours
from winnow.operators.units import Lines, split_source
from winnow.plans.search import selection_units

HARBOUR = '''from math import pi

LIMIT = 4


class Harbour:
    depth = 9
    # berths are counted from the mole

    @staticmethod
    def berth(n):
        return n * pi

    class Crane:
        def lift(self):
            pass

    async def open(self):
        return True


@cached
@logged
def tide(hour):
    def inner():
        return hour
    return inner
'''


def units(path, text, most=24_000):
    return [(u.name, u.start_line, u.end_line) for u in inspect(path, text, most).units]


def covered(path, text):
    """The lines that some unit holds; no line is in two whole units of one kind."""
    return {i for _, a, b in units(path, text) for i in range(a, b + 1)}


def test_python_members_and_what_lies_between():
    got = units("harbour.py", HARBOUR)
    named = dict.fromkeys(n for n, _, _ in got)
    assert list(named)[-1] == "tide" and {"Harbour.context", "Harbour.berth", "Harbour.open", "tide"} <= set(named)
    by = {(n, a): b for n, a, b in got}
    assert by["Harbour.berth", 10] == 12  # with its decorator
    assert by["tide", 22] == 27  # inner functions belong to it
    assert by["Harbour.open", 18] == 19
    whole = inspect("harbour.py", HARBOUR, 24_000)
    assert whole.mode == "python" and whole.comments == [(8, 8)]
    lines = HARBOUR.split("\n")
    assert all(lines[i - 1].strip() == "" or i in covered("harbour.py", HARBOUR) for i in range(6, 28))
    assert all(u.headers and u.headers[0][0] == 6 for u in whole.units if u.name in ("Harbour.berth", "Harbour.open"))


@pytest.mark.parametrize("text", ["exec 'code'\n", "n = 0755\n", "a = 1\rb = 2\n", "class Open(:\n", "if True:\nx\n"])
def test_python_that_does_not_parse_is_text(text):
    i = inspect("old.py", text)
    assert i.mode == "text" and all(u.name == "source" and u.partial for u in i.units)


def test_neighbours_of_chosen_methods():
    body = "".join(f"    def m{i}(self):\n        return {i}\n\n" for i in range(6))
    text = "class Quay:\n    wide = 2\n\n" + body
    at = {i: 4 + 3 * i for i in range(6)}
    assert python_neighbours(text, [(at[2], at[2] + 1)]) == [(1, 3), (at[1], at[1] + 1), (at[3], at[3] + 1)]
    assert python_neighbours(text, [(at[0], at[0])]) == [(1, 3), (at[1], at[1] + 1)]
    assert python_neighbours(text, [(2, 2)]) == [] and python_neighbours("exec 'x'\n", [(1, 1)]) == []
    long = "class Quay:\n    wide = 2\n\n    def a(self):\n" + "        x = 1\n" * 60 + "\n    def b(self):\n        pass\n"
    assert python_neighbours(long, [(66, 67)]) == [(1, 3)]  # a long neighbour stays out


def test_go():
    text = "package lock\n\nimport (\n\t\"fmt\"\n)\n\n// Gate opens.\ntype Gate struct {\n\twide int // metres\n}\n\nvar Low, High = 1, 2\n\nfunc (g Gate) Open(to string) error {\n\tfmt.Println(`}`, to)\n\treturn nil\n}\n\nfunc fill() {}\n"
    got = units("lock.go", text)
    by = {n: (a, b) for n, a, b in got}
    assert by["Gate"] == (8, 10) and by["Gate.Open"] == (14, 17) and by["fill"] == (19, 19) and by["package lock"] == (1, 1)
    assert by["Low, High"] == (12, 12)
    assert (7, 7) in inspect("lock.go", text).comments


def test_rust():
    text = "//! Sluices.\n\n/// How much.\n#[derive(Clone)]\npub struct Sluice { open: bool }\n\nimpl Sluice {\n    pub fn flow(&self) -> u8 {\n        '{' as u8\n    }\n\n    #[must_use]\n    fn shut(self) {}\n}\n\npub mod weir {\n    pub fn height() -> u32 { 3 }\n}\n"
    by = {}
    for n, a, b in units("sluice.rs", text):
        by.setdefault(n, []).append((a, b))
    assert by["Sluice"] == [(1, 5)]  # all comments and attributes before it are its own
    assert by["Sluice.flow"] == [(8, 10)] and by["Sluice.shut"] == [(12, 13)] and by["weir.height"] == [(17, 17)]
    own = next(u for u in inspect("sluice.rs", text).units if u.name == "Sluice.shut")
    assert (7, 7) in own.headers


def test_scripts():
    text = "import { moor } from './rope';\n\nexport default class Buoy {\n  colour = 'red';\n\n  /* rings */\n  ring(): number {\n    return moor(`${1}}`);\n  }\n}\n\nlet near = 1, far = 2;\nasync function drift() {}\nexport const sink = () => {\n  near = 0;\n};\n"
    by = {n: (a, b) for n, a, b in units("buoy.ts", text)}
    assert by["Buoy.ring"] == (7, 9) and by["near, far"] == (12, 12) and by["drift"] == (13, 13) and by["sink"] == (14, 16) and by["source"] == (1, 1)
    assert (6, 6) in inspect("buoy.ts", text).comments
    assert units("Sail.tsx", "export function Sail() {\n  return <p>{'}'}</p>;\n}\n") == [("Sail", 1, 3)]
    assert ("Mast.up", 2, 2) in units("mast.jsx", "class Mast {\n  up() {}\n}\n")


def test_unbalanced_source_is_text():
    for path, text in (("a.ts", "function open( {\n// why\n"), ("a.go", "package a\nfunc f() {\n"), ("a.rs", "fn f() { \"never closed\n")):
        i = inspect(path, text)
        assert i.mode == "text" and all(u.name == "source" for u in i.units)
    assert inspect("a.ts", "function open( {\n// why\n").comments == [(2, 2)]
    assert units("page.md", "# Harbour\n\nBoats.\n") == [("source", 1, 4)]


def test_large_declarations_are_cut():
    text = "def long():\n" + "".join(f"    step_{i} = {i}\n" for i in range(300))
    own = inspect("long.py", text, 900).units
    assert len(own) > 1 and all(u.name == "long" and u.partial and u.byte_end - u.byte_start <= 900 for u in own)
    assert own[0].start_line == 1 and own[-1].end_line == 301 and [u.byte_start for u in own[1:]] == [u.byte_end for u in own[:-1]]


def test_pieces_of_a_text_are_all_of_it():
    r = random.Random(1)
    for _ in range(30):
        text = "".join(r.choice(["a", "é", "漢", "😀", "\n"]) for _ in range(r.randrange(1, 60)))
        most = r.randrange(4, 20)
        own, raw = split_source(text, most), text.encode()
        assert b"".join(raw[u.byte_start : u.byte_end] for u in own) == raw
        assert all(0 < u.byte_end - u.byte_start <= most for u in own)
        for u in own:
            raw[u.byte_start : u.byte_end].decode()  # at character boundaries
            assert u.start_line == raw[: u.byte_start].count(b"\n") + 1
    with pytest.raises(ValueError):
        split_source("boat", 3)


def test_lines():
    t = Lines("north\nsea\n")
    assert len(t) == 3 and t.starts == [0, 6, 10] and [t.at(b) for b in (0, 5, 6, 9)] == [1, 1, 2, 2]
    assert t.text(1, 2) == "north\nsea" and t.text(2, 3) == "sea\n"


def test_selection_units_and_their_groups():
    body = "".join(f"def f{i}():\n    return {i}\n\n" for i in range(400))
    lines, own = Lines(body), selection_units("many.py", body)
    assert [u.name for u in own] == [f"f{i}" for i in range(400)]
    parts = grouping.groups(own, lines)
    assert [u for g in parts for u in g] == own and max(map(len, parts)) <= 128 and len(parts) == 4
    assert grouping.context(lines, own[:2]) == body  # a small file goes whole
    big = body * 3
    lines, own = Lines(big), selection_units("many.py", big)
    shown = grouping.context(lines, own[500:503])
    a, b = own[500].start_line - 8, own[502].end_line + 8
    assert shown == f"Opening context:\n{lines.text(1, 20)}\nSource lines {a}-{b}:\n{lines.text(a, b)}"
    giant = "x = 1\n" + "y" * 50_000 + "\nz = 2\n"
    own = selection_units("wide.txt", giant)
    assert all(u.byte_end - u.byte_start <= 24_000 for u in own)
    assert grouping.context(Lines(giant), own[:1]).startswith(f"Source lines {own[0].start_line}-{own[0].end_line}; source bytes 0-")
    tall = "def tall():\n" + "    # " + "w" * 60 + "\n" + "    y = 'wwwwwwwwwwwwwwwwwwwwwwwwwwwwwwwwwwwwwwwwwwwwwwwwww'\n" * 600
    blocks = selection_units("tall.py", tall)
    assert all(u.name == "tall" and u.end_line - u.start_line < 16 for u in blocks) and blocks[0].start_line == 1 and blocks[1].start_line == 17
    assert list(grouping.halved([1, 2, 3, 4, 5], lambda g: sum(g) > 6)) == [[1, 2, 3], [4], [5]]
