import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions.paths import PathError, canonical_json, compile_path, number_text, stored_bytes

BAKERY = {
    "order": {"customer": {"name": "Noor", "vip": False}, "lines": [{"bread": "rye", "loaves": 3}, {"bread": "oat", "loaves": 0.25}]},
    "oven.no": {"7": "seventh", "back\\room": "cold", 'the "big" one': "hot", "": "nameless"},
    "price-list": [[1.5, 2], ["free"]],
    "weights": {"huge": 98765432109876543210, "dust": 3e-9, "ton": 1e6, "debt": -0.00042, "zero": 0},
    "closed": None,
}
#: Expression, steps it stands for.
SELECTIONS = [
    ("$.order.customer.name", ["order", "customer", "name"]),
    ("$.order.customer.vip", ["order", "customer", "vip"]),
    ("$.order.lines[1].bread", ["order", "lines", 1, "bread"]),
    ("$.order.lines[-2].loaves", ["order", "lines", -2, "loaves"]),
    ("$.order.lines[-1].loaves", ["order", "lines", -1, "loaves"]),
    ('$.x["y"]', ["x", "y"]),
    ("$.price-list[0][0]", ["price-list", 0, 0]),
    ("$.price-list[-1][-1]", ["price-list", -1, -1]),
    ("$.weights.huge", ["weights", "huge"]),
    ("$.weights.dust", ["weights", "dust"]),
    ("$.weights.ton", ["weights", "ton"]),
    ("$.weights.debt", ["weights", "debt"]),
    ("$.weights.zero", ["weights", "zero"]),
    ("$.closed", ["closed"]),
    ("$.order", ["order"]),
    ("$.order.lines", ["order", "lines"]),
    ("$.order.lines[2].bread", ["order", "lines", 2, "bread"]),
    ("$.order.lines[-3].bread", ["order", "lines", -3, "bread"]),
    ("$.order[0]", ["order", 0]),
    ("$.order.lines.bread", ["order", "lines", "bread"]),
]


def looked_up(doc, steps):
    """The selected value by plain indexing; None where the steps lead nowhere."""
    try:
        for s in steps:
            assert isinstance(doc, dict) == isinstance(s, str)
            doc = doc[s]
    except (KeyError, IndexError, TypeError, AssertionError):
        return None
    return doc


def as_text(value):
    if isinstance(value, bool):
        return json.dumps(value)
    return value if isinstance(value, str) else None if value is None or isinstance(value, (dict, list)) else number_text(float(value))


@pytest.mark.parametrize("expression,steps", SELECTIONS)
def test_steps_and_value(expression, steps):
    path = compile_path(expression)
    assert list(path.steps) == steps and path.resolve(BAKERY) == as_text(looked_up(BAKERY, steps))


def test_numbers_are_written_out():
    texts = {k: compile_path(f"$.weights.{k}").resolve(BAKERY) for k in BAKERY["weights"]}
    assert texts == {"huge": "98765432109876540000", "dust": "0.000000003", "ton": "1000000", "debt": "-0.00042", "zero": "0"}


def test_column_equals_python(spark):
    df = spark.createDataFrame([(json.dumps(BAKERY),)], "raw string").select(F.parse_json("raw").alias("doc"))
    every = [e for e, _ in SELECTIONS] + [quoted("oven", k) for k in BAKERY["oven.no"]]
    doc = {**BAKERY, "oven": BAKERY["oven.no"]}
    df = df.unionByName(spark.createDataFrame([(json.dumps(doc),)], "raw string").select(F.parse_json("raw").alias("doc")))
    paths = [compile_path(e) for e in every]
    rows = df.select(*[p.column().alias(f"c{k}") for k, p in enumerate(paths)]).collect()
    assert [list(r) for r in rows] == [[p.resolve(d) for p in paths] for d in (BAKERY, doc)]
    assert list(rows[1])[-4:] == list(BAKERY["oven.no"].values())


def quoted(start, key):
    """The expression of a key in quotes below a plain one."""
    return f'$.{start}["' + key.replace("\\", "\\\\").replace('"', '\\"') + '"]'


plain_keys = st.text(st.characters(exclude_characters=".[", exclude_categories=["Cs"]), min_size=1, max_size=6)
any_steps = st.lists(st.one_of(st.integers(-9, 9), st.text(st.characters(exclude_categories=["Cs"]), max_size=6)), max_size=4)


@given(plain_keys, any_steps)
def test_any_selection_can_be_written(first, more):
    steps = [first, *more]
    expression = f"$.{first}" + "".join(f"[{s}]" if isinstance(s, int) else quoted("", s)[2:] for s in more)
    path = compile_path(expression)
    assert list(path.steps) == steps
    assert compile_path(path.canonical()) == type(path)(path.canonical(), path.steps) if steps[0] and not steps[0].isdecimal() and "." not in steps[0] else True
    doc = "end"
    for s in reversed(steps):
        doc = {s: doc} if isinstance(s, str) else [doc] * 10
    assert path.resolve(doc) == "end"


json_values = st.recursive(
    st.none() | st.booleans() | st.integers(-(2**70), 2**70) | st.floats(allow_nan=False, allow_infinity=False) | st.text(st.characters(exclude_categories=["Cs"]), max_size=5) | st.sampled_from(["007", "12", "-0", "1e3", "true", "null", "{", "[1]", '"', "12\n", "x y"]),
    lambda inner: st.lists(inner, max_size=3) | st.dictionaries(st.sampled_from(["a", "b", "c d"]), inner, max_size=3),
    max_leaves=6,
)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.dictionaries(st.sampled_from(["a", "b"]), json_values, max_size=2), min_size=40, max_size=60))
def test_text_and_variant_agree(spark, docs):
    """What is read from the text is what the variant gives, and what plain Python gives."""
    paths = [compile_path(e) for e in ("$.a", "$.b", "$.a.b", "$.a.a.b", "$.a[0]", "$.b.a[-1]")]
    df = spark.createDataFrame([(json.dumps(d),) for d in docs], "raw string").withColumn("doc", F.parse_json("raw")).coalesce(1)
    rows = df.select(*[p.column("doc", "raw").alias(f"t{k}") for k, p in enumerate(paths)], *[p.column().alias(f"v{k}") for k, p in enumerate(paths)]).collect()
    for d, r in zip(docs, rows, strict=True):
        n = len(paths)
        assert list(r)[:n] == list(r)[n:]
        for p, got in zip(paths, list(r)[:n], strict=True):
            want = p.resolve(json.loads(json.dumps(d)))
            assert got == want or (want is not None and got is not None and number_like(want) and float(got) == float(want)), (d, p)


def number_like(text):
    try:
        return text.strip() == text and float(text) == float(text)
    except ValueError:
        return False


#: What breaks an expression when put after a well-formed one, or in place of its beginning.
BAD_ENDS = [".", "..z", "[", "[]", "[-]", "[1", "[2.5]", "[ 1]", "[x]", '["', '["q', '["q"', '["q"x]', '["\\n"]', '["\\', "]"]
BAD_STARTS = ["", ".", "$", "$.", "$..", "$[", "$$.", " $."]


@given(plain_keys, st.sampled_from(BAD_ENDS))
def test_bad_ends(key, end):
    expression = f"$.{key}{end}"
    if end == "]":  # a bracket alone belongs to a plain key
        assert compile_path(expression).steps == (key + "]",)
        return
    with pytest.raises(PathError) as e:
        compile_path(expression)
    assert expression in str(e.value)


@pytest.mark.parametrize("start", BAD_STARTS)
def test_bad_starts(start):
    with pytest.raises(PathError):
        compile_path(start + "[0]" if start else "word")


def test_one_spelling():
    assert compile_path('$.shop["till"]').canonical() == compile_path("$.shop.till").canonical()
    assert compile_path('$.shop["3"]["a.b"][-4]').canonical() == '$.shop["3"]["a.b"][-4]'
    assert compile_path("$.shelf[5].box[6]").last_segment() == "box"


@given(st.floats(allow_nan=False, allow_infinity=False))
def test_numbers_have_no_exponent(x):
    text = number_text(x)
    assert "e" not in text.lower() and float(text) == x


def test_equal_documents_and_bytes():
    assert canonical_json({"k": [2.0], "j": 7}) == canonical_json({"j": 7.0, "k": [2]})
    assert canonical_json({"k": 1}) != canonical_json({"k": True})
    assert stored_bytes({"z": 4.0, "y": "<&"}) == len('{"y":"\\u003c\\u0026","z":4}')
    assert stored_bytes({"q": [1e22, 2e-8, False, None]}) == len('{"q":[1e+22,2e-8,false,null]}')
