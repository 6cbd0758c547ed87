import ast

from pyspark.sql import functions as F

from marquee.operators import profile

CELLS = [
    "[]", "[ ]", "[{}]", "[{'id': 1, 'name': 'a'}]", "[{'id': 1, 'name': \"O'B\"}, 7]", "[7, None]", "[{'id': 5, 'name': ", "[{'id': 5, 'name': # x:", "{'id': 1}", "5", "None", "'a:'", "[1], 5",
    "", " ", "oops", "[{'id': 5", "{", "x[", "lambda:", "[{'id': 01}]", "[{'id': -0}]", "[{'id': 1, 'name': 'a\\'b'}]", "[{'id': 1}] ", "[{'id': True}]", "[true]", "[{'id': 1.5}]", "(1,)", "'''a:", "[] # (", "[1, # [\n2]", None,
]


def state(cell):
    if cell is None:
        return None
    try:
        return "empty_list" if ast.literal_eval(cell) == [] else "ok"
    except Exception:
        return "failed"


def test_states_are_those_of_pythons_reader(spark):
    df = spark.createDataFrame(list(enumerate(CELLS)), "n int, cell string")
    found = profile._with_state(df, "state", "cell").orderBy("n").collect()
    assert [(r.cell, r.state) for r in found] == [(c, state(c)) for c in CELLS]


def test_cells_of_known_kinds_are_judged_in_the_engine(spark, monkeypatch):
    """Numbers among the dicts and cells that break off: nothing that the Python way is handed."""
    def refuse(kind):
        refused = lambda c: F.when(c.isNotNull(), F.raise_error(F.lit("a cell reached Python")).cast(kind))
        return lambda function: type("Refused", (), {"asNondeterministic": lambda self: refused})()

    monkeypatch.setattr(profile.F, "arrow_udf", refuse)
    rows = spark.createDataFrame([("[{'id': 1, 'name': \"O'Brien\"}, 7]",), ("[{'id': 2, 'name': ",), ("[]",), ("[{'id': 3, 'name': None}]",)], "cell string")
    report = profile.cell_quality(rows, ["cell"]).first()
    assert tuple(report) == ("cell", 4, 3, 1, 1)
