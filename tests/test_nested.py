import ast

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marquee.operators import nested

FIELDS = {"id": "long", "name": "string", "p": "string"}
CELLS = [
    None, "", "nan", "None", "[]", " [ ] ", "[{'id': 1, 'name': \"O'B\", 'p': None}]", "[{'id': 1, 'name': 'a', 'p': 'None, True'}]",
    "[{'id': 1, 'name': 'tru", "{'id': 1}", "[1, {'id': 2, 'name': 'x'}]", "[{'id': '12', 'name': 5, 'p': 1.50}]", "[{'id': 1.0, 'name': True}]",
    "[{'id': 'x', 'name': 'y'}]", "[{'id': -0, 'name': -0}]", "[{'id': 007}]", "[{'id': 1}, {'id': 2}], 'x': 1", "[{'id': {'a': 1}, 'name': {'b': 2}}]",
    "[{'id': 3, 'name': 'a\\'b\\u00e9\\n'}]", "[{'id': 99999999999999999999, 'name': 99999999999999999999}]", "[{'id': 1, 'name': 'x'},]", "({'id': 1},)",
    "[{'id': 4, 'name': 'tab\there'}]", "[{'id': 4, 'name': 'line\nbreak'}]", "[{'id': 5,\n 'name': 'ok'}]", "[[{'id': 1}]]", "[{'id': 1e3, 'name': 1e3}]",
    r"[{'id': 1, 'name': 'a\\'}, {'id': 2, 'name': 'b'}]", r"[{'id': 1, 'name': 'a\\\'b', 'p': \"c\\\"d'e\"}]", r"[{'id': 1, 'name': 'q\"r\" \x41\a\v\b\f\0 \101'}]",
    r"[{'id': 1, 'name': '\ud83d\ude00', 'p': '\u00e9\U0001F600'}]", r"[{'id': 1, 'name': '\d \N{BULLET}'}]", "[{'id': 1, 'name': \"a\nb\"}]", "[{'id': 1,\n \"name\": \"it's\"}]\n",
    r"[{'id': 1, 'name': 'a\\u0041\\n'}]", "[{'id': 1, 'name': \"x\x01\"}]", "[{'id': 1, 'name': b'x'}]", "[{'id': 1, 'name': r\"x\"}]", "[{'id': 1, 'name': \"x\"] # y", r"[{'id': 1, \n'name': 'x'}]", "[{'id': 1, 'name': 'a\rb'}]",
    "[{'id': 6, 'name': 'a' 'b'}]", "[{'id': 1_000}]", "[{'id': 8, 'id': 9}]", "[None]", "[{'id': NoneNone}]",
]


def parsed(spark, cells, many, native):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "n int, cell string")
    out = nested.with_literal(df, "v", "cell", FIELDS, many, native).orderBy("n").collect()
    return [r["v"] for r in out]


@pytest.mark.parametrize("many", [True, False])
def test_both_readers_agree(spark, many):
    cells = [*CELLS, "{'id': 7, 'name': 'Saga', 'p': None}", "{'id': 7, 'name': {'x': 1}}"]
    native, python = parsed(spark, cells, many, True), parsed(spark, cells, many, False)
    for cell, mine, theirs in zip(cells, native, python):
        assert mine == theirs, cell


def test_values(spark):
    values = dict(zip(CELLS, parsed(spark, CELLS, True, True)))
    assert values["[]"] == [] and values["{'id': 1}"] is None and values["[{'id': 1, 'name': 'tru"] is None
    assert values["[{'id': 1, 'name': \"O'B\", 'p': None}]"] == [(1, "O'B", None)]
    assert values["[1, {'id': 2, 'name': 'x'}]"] == [None, (2, "x", None)]
    empty = spark.createDataFrame([(None,), ("oops",)], "cell string")
    assert [r["v"] for r in nested.with_literal_list(empty, "v", "cell", FIELDS).collect()] == [[], []]


def python_rows(spark, cells):
    """How many cells go on to Python."""
    df = spark.createDataFrame([(c,) for c in cells], "cell string")
    return nested.with_json(df, "json", "cell").where("json is null").count()


def test_well_formed_cells_stay_in_the_engine(spark):
    """Quotes, escapes and line breaks in the notation of Python are no reason to leave the engine."""
    names = ["O'Brien", 'the "Rock"', "it's \"both\"", "back\\slash", "tab\tnew\nline", "é\u4e2d", "\x07\x0b\x0c\x08", "", "None, [x] {y}"]
    cells = [repr([{"id": i, "name": n, "p": None}, {"id": -i - 1, "name": n + n, "p": "'"}]) for i, n in enumerate(names)]
    assert [ast.literal_eval(c)[0]["name"] for c in cells] == names
    assert python_rows(spark, cells) == 0
    assert [[tuple(i) for i in v] for v in parsed(spark, cells, True, True)] == [[(i["id"], i["name"], i["p"]) for i in ast.literal_eval(c)] for c in cells]


def test_long_cells_with_many_quotes(spark):
    cell = repr([{"id": i, "name": "O'B\\\"" * 500, "p": None} for i in range(40)])
    found = parsed(spark, [cell], True, True)[0]
    assert python_rows(spark, [cell]) == 0 and len(found) == 40 and found[7].name == "O'B\\\"" * 500


text = st.text(alphabet=st.sampled_from("ab'\"\\,:{}[] \té0None\nx\x07"), max_size=8)
item = st.fixed_dictionaries({"id": st.one_of(st.none(), st.integers(-(2**40), 2**40)), "name": st.one_of(st.none(), text)})


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(item, max_size=3), min_size=20, max_size=40))
def test_round_trip_of_python_lists(spark, lists):
    cells = [repr(v) for v in lists]
    assert [ast.literal_eval(c) for c in cells] == lists
    got = parsed(spark, cells, True, True)
    assert [[(i["id"], i["name"], None) for i in v] for v in lists] == [[tuple(i) for i in v] for v in got]


def test_entities_and_links(spark):
    rows = [
        (1, 10, "[{'id': 1, 'name': 'Drama'}, {'id': 2, 'name': None}, {'id': 1, 'name': 'Drama'}]"),
        (2, 11, "[{'id': 1, 'name': 'Other'}, {'id': 3, 'name': 'War'}, {'name': 'x'}]"), (3, 12, "oops"),
    ]
    df = spark.createDataFrame(rows, "n int, id int, genres string")
    found = nested.id_name_items(df, "id", "genres", ["n"])
    assert {tuple(r) for r in nested.entities(found, ["n"]).collect()} == {(1, "Drama"), (3, "War")}
    assert {tuple(r) for r in nested.junction(found, "genre_id").collect()} == {(10, 1), (11, 1), (11, 3)}


def test_codes(spark):
    cell = "[{'c': ' US ', 'name': 'America'}, {'c': 'usa', 'name': 'x'}, {'c': '', 'name': 'y'}, {'c': 'us', 'name': 'Late'}, {'c': 'fr', 'name': ''}]"
    df = spark.createDataFrame([(1, 5, cell)], "n int, id int, v string")
    found = nested.iso_name_items(df, "id", "v", ["n"], "c")
    assert [tuple(r) for r in nested.entities(found, ["n"]).collect()] == [("us", "America")]


def test_credits(spark):
    cast = (
        "[{'id': 1, 'name': 'A', 'order': 0, 'character': '', 'gender': 2, 'profile_path': None}, {'id': 2, 'name': 'B', 'character': 'Hero'},"
        " {'id': 1, 'name': 'A2', 'order': 0, 'character': 'again'}, {'id': 1, 'name': 'A', 'order': 1, 'character': 'Twin'}, {'id': 9, 'name': None, 'order': 2}]"
    )
    crew = "[{'id': 3, 'name': 'C', 'job': '', 'department': 'x'}, {'id': 4, 'name': 'D', 'job': 'Director', 'department': ''}, {'id': 1, 'name': 'Z', 'job': 'Writer'}]"
    df = spark.createDataFrame([(1, 50, cast, crew)], "n int, id int, cast string, crew string")
    c, w = nested.cast_items(df, "id", "cast", ["n"]), nested.crew_items(df, "id", "crew", ["n"])
    assert {tuple(r) for r in nested.cast_table(c, ["n"]).collect()} == {(50, 1, 0, None), (50, 1, 1, "Twin")}
    assert {tuple(r) for r in nested.crew_table(w, ["n"]).collect()} == {(50, 4, "Director", None), (50, 1, "Writer", None)}
    people = {tuple(r) for r in nested.people(c, w, ["n"]).collect()}
    assert people == {(1, "A", 2, None), (2, "B", None, None), (4, "D", None, None)}


def test_collections(spark):
    df = spark.createDataFrame([(1, "{'id': 7, 'name': 'Saga', 'poster_path': None}"), (2, "{'id': 7, 'name': 'Late'}"), (3, "[]")], "n int, c string")
    assert [tuple(r) for r in nested.collections(df, "c", ["n"]).collect()] == [(7, "Saga", None, None)]
    ids = nested.with_collection_id(df, "cid", "c").orderBy("n").collect()
    assert [r["cid"] for r in ids] == [7, 7, None]


def test_cells_are_parsed_once(spark):
    df = spark.createDataFrame([(1, 1, "[]")], "n int, id int, cast string")
    plan = nested.cast_table(nested.cast_items(df, "id", "cast", ["n"]), ["n"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("from_json") == 1


ODD_CELLS = [
    "[]", "[{}]", "[{'id': 1, 'name': 'a'}, 7]", "[7, -8, {'id': 2, 'name': None}, None, 0]", "[{'id': 3, 'name': 'x, 7, y'}, 7]", "[{'id': 4, 'name': '[5, 6]'}, 5]",
    "[{'id': 5, 'name': 'None'}]", "[{'id': 6, 'name': 'Nono'}, {'id': None, 'name': \"O'Brien\"}]", "[{'id': 7, 'name': 'say \"x\"'}]", "[{'id': 8, 'name': ", "[{'id': 9, 'name': 'x",
    "([{'id': 10, 'name': 'x'}])", "[{'id': 11, 'name': 'x'}] # note", "[{'id': 12}] # 'x'", "{'id': 13, 'name': 'y'}", "{'id': 14, 'name': '", "[{'id': 15, 'name': 'x'}]  ", "[{'id': 01}]", "[{'id': -0}]",
    "[{'id': 99999999999999999999, 'name': 'x'}]", "[{'id': 16, 'name': 'a' 'b'}]", "[{'id': 17, 'name': '''z'''}]", "[{'id': 18, 'name': 'x'},]", "[{'id': 19, 'name': 'x'} {'id': 20}]", "5", "None", "", None,
    "[{'id': 21, 'name': True}]", "[1.5, {'id': 22}]", "[{'id': 23, 'name': 'tab\there'}]", "[{'id': 24, 'name': 'a\\\\'}]", "[" + ", ".join(f"{{'id': {i}, 'name': 'n{i}'}}" for i in range(5000)) + "]",
]


@pytest.mark.parametrize("many", [True, False])
def test_simple_cells_are_read_as_python_reads_them(spark, many):
    fields = {"id": "long", "name": "string"}
    df = spark.createDataFrame(list(enumerate(ODD_CELLS)), "i int, cell string")
    native, plain = (nested.with_literal(df, "v", "cell", fields, many, native).orderBy("i").collect() for native in (True, False))
    assert [(r.cell and r.cell[:60], r.v) for r in native] == [(r.cell and r.cell[:60], r.v) for r in plain]


def test_irregular_cells_of_known_kinds_stay_out_of_python(spark, monkeypatch):
    """Numbers among the dicts and cells that break off: nothing that the Python way is handed."""
    monkeypatch.setattr(nested, "_literal_udf", lambda fields, many: lambda c: F.when(c.isNotNull(), F.raise_error(F.lit("a cell reached Python")).cast("array<struct<id:long,name:string>>")))
    cells = [("[{'id': 1, 'name': \"O'Brien\"}, 7]",), ("[{'id': 2, 'name': ",), ("[{'id': 3, 'name': None}]",)]
    rows = nested.with_literal(spark.createDataFrame(cells, "cell string"), "v", "cell", {"id": "long", "name": "string"}).collect()
    assert [r.v and [x and tuple(x) for x in r.v] for r in rows] == [[(1, "O'Brien"), None], None, [(3, None)]]


def test_rows_are_dealt_out_by_their_key_without_a_sort(spark):
    rows = [(i, i % 3, f"[{{'id': {i}, 'name': 'n'}}]") for i in range(50)]
    df = spark.createDataFrame(rows, "n int, id int, v string")
    found = nested.id_name_items(df, "id", "v", ["n"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "REBALANCE_PARTITIONS_BY_COL" in plan and "RoundRobin" not in plan
    assert {tuple(r) for r in found.select("n", "movie_id", "id").collect()} == {(n, i, n) for n, i, _ in rows}


@pytest.mark.parametrize("control", [chr(i) for i in (*range(32), 127)])
def test_no_control_character_is_simple(control):
    import re

    assert not re.match(nested.SIMPLE_LIST.replace(r"\z", r"\Z"), f"[{{'id': 1, 'name': 'a{control}b'}}]")
