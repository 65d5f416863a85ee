"""Null and type rules of every expression, and the list, struct and conditional fixtures."""

import math

import pytest
from pyspark.sql import functions as F

import pathloom as pl
from pathloom.functions.expr import Expr
from pathloom.plans.compiler import Compiler, ExpressionError

N = pl.lit(None)


def values(spark, **exprs):
    """Each expression's value on one row: dest has b, i, f, s, xs, n (null int), ns (null list), st; state has nothing."""
    row = spark.range(1).select(
        F.struct(F.lit(7).cast("bigint").alias("i"), F.lit(True).alias("b"), F.lit(2.0).alias("f"), F.lit("a.b").alias("s"), F.lit(None).cast("bigint").alias("n"), F.lit(None).cast("array<bigint>").alias("ns"), F.lit(None).cast("boolean").alias("nb"),
                 F.expr("array(3L, 1L, null, 1L)").alias("xs"), F.expr("array(true, null)").alias("bs"), F.expr("array('x', null, 'y')").alias("ts"), F.expr("array(array(1L), array(), null, array(2L, 3L))").alias("xss"),
                 F.expr("named_struct('p', 1L, 'q', 'u')").alias("st"), F.expr("array(1.5D, double('nan'))").alias("fs")).alias("dest"),
        F.struct(F.lit(1).alias("id")).alias("src"), F.struct(F.lit(1).alias("id")).alias("edge"), F.struct(F.lit(1).alias("z")).alias("state"))
    compiler = Compiler(row)
    return row.select(*(compiler.compile(e).column.alias(k) for k, e in exprs.items())).first().asDict(recursive=True)


def d(name):
    return pl.col(f"dest.{name}")


def test_scalars(spark):
    got = values(
        spark, a=N & True, o=N | True, n=~N, eq=N == 1, eq2=N == N, ne=N != 1, cross=d("s") == 1, lt=d("n") < 1, add=d("n") + 1, mixed=d("i") + 0.5, sub=3 - d("i"), div=d("i") / 2, inf=d("i") / 0, nan=pl.lit(0) / 0, rem=pl.lit(-7) % 3,
        band=d("i").bit_and(3), bor=d("i").bit_or(8), bxor=d("i").bit_xor(1), m0=d("i").mask_if_any(8, 5), m1=d("i").mask_if_any(1, 5), isn=d("n").is_null(), notn=d("n").is_not_null(), missing=pl.col("state.none").is_null(),
        c1=d("i").cast("float"), c2=d("b").cast("string"), c3=d("f").cast("string"), c4=(d("f") / 3).cast("string"), c5=d("n").cast("string"), c6=pl.lit(1e20).cast("string"),
        w=pl.when(N).then(1).otherwise(2), w2=pl.when(d("i") > 100).then(1).when(d("i") > 5).then(2).otherwise(3), w3=pl.when(d("i") > 100).then(1), lazy=pl.when(True).then(1).otherwise(d("s") + 1),
        sc=d("s").str.contains("."), sc2=d("s").str.contains("axb"), sw=d("s").str.starts_with("a"), ew=d("s").str.ends_with("x"), al=d("i").alias("other"))
    assert got["nan"] is not None and math.isnan(got.pop("nan"))
    assert got == {
        "a": False, "o": True, "n": True, "eq": False, "eq2": True, "ne": True, "cross": False, "lt": None, "add": None, "mixed": 7.5, "sub": -4, "div": 3.5, "inf": math.inf, "rem": -1, "band": 3, "bor": 15, "bxor": 6, "m0": 0, "m1": 5,
        "isn": True, "notn": False, "missing": True, "c1": 7.0, "c2": "true", "c3": "2", "c4": "0.6666666666666666", "c5": None, "c6": "100000000000000000000", "w": 2, "w2": 2, "w3": None, "lazy": 1, "sc": True, "sc2": False, "sw": True, "ew": False, "al": 7}


def test_lists(spark):
    xs, e = d("xs"), pl.element()
    got = values(
        spark, len=xs.list.len(), nlen=d("ns").list.len(), c=xs.list.contains(1), cn=xs.list.contains(N), c0=xs.list.contains(9), cx=xs.list.contains(N, nulls_equal=False), cs=xs.list.contains("1"), g=xs.list.get(-1), go=xs.list.get(9, null_on_oob=True), f=xs.list.first(), l=xs.list.last(),
        s1=xs.list.slice(-9, 2), s2=xs.list.slice(1, 2), s3=xs.list.slice(-2, 5), s4=xs.list.slice(0, -1), r=xs.list.reverse(), so=xs.list.sort(), sd=xs.list.sort(descending=True), sl=xs.list.sort(nulls_last=True), sdl=xs.list.sort(descending=True, nulls_last=True),
        u=xs.list.unique(), dn=xs.list.drop_nulls(), sum=xs.list.sum(), es=pl.lit([]).list.sum(), mi=xs.list.min(), ma=xs.list.max(), ami=xs.list.arg_min(), ama=xs.list.arg_max(), nami=d("ns").list.arg_min(), me=xs.list.mean(), med=xs.list.median(), eme=pl.lit([None]).list.mean(),
        any=d("bs").list.any(), all=d("bs").list.all(), allk=d("bs").list.all(ignore_nulls=False), anyk=d("bs").list.any(ignore_nulls=False), cm=xs.list.count_matches(1), cmn=xs.list.count_matches(N), nu=xs.list.n_unique(), j=d("ts").list.join("-"), js=d("ts").list.join("-", ignore_nulls=False), jn=d("ts").list.join(N),
        sh=xs.list.shift(1), sh2=xs.list.shift(-1), ge=xs.list.gather_every(2, 1), gn=xs.list.gather_every(2, -5), su=xs.list.set_union([5, 1]), si=xs.list.set_intersection([1, 5]), sdi=xs.list.set_difference([1]), sy=xs.list.set_symmetric_difference([1, 5]), sn=d("ns").list.set_union([1]),
        ev=xs.list.eval(e + d("i")), fi=xs.list.filter(e >= 1), fx=xs.list.filter(e == d("n")), ex=d("xss").list.explode(), ex1=xs.list.explode(), ts=xs.list.to_struct(["p", "q"]), cl=pl.concat_list([xs, 8, N, d("ns")]),
        lift=d("ts").list.eval(pl.when(e == "x").then(["k", "l"]).otherwise(e)).list.explode())
    assert got == {
        "len": 4, "nlen": None, "c": True, "cn": True, "c0": False, "cx": None, "cs": False, "g": 1, "go": None, "f": 3, "l": 1, "s1": [3, 1], "s2": [1, None], "s3": [None, 1], "s4": [], "r": [1, None, 1, 3], "so": [None, 1, 1, 3], "sd": [None, 3, 1, 1], "sl": [1, 1, 3, None], "sdl": [3, 1, 1, None],
        "u": [3, 1, None], "dn": [3, 1, 1], "sum": 5, "es": 0, "mi": 1, "ma": 3, "ami": 1, "ama": 0, "nami": None, "me": 5 / 3, "med": 1.0, "eme": None, "any": True, "all": True, "allk": None, "anyk": True, "cm": 2, "cmn": 1, "nu": 3, "j": "x-y", "js": None, "jn": None,
        "sh": [None, 3, 1, None], "sh2": [1, None, 1, None], "ge": [1, 1], "gn": [3, None], "su": [3, 1, None, 5], "si": [1], "sdi": [3, None], "sy": [3, None, 5], "sn": None, "ev": [10, 8, None, 8], "fi": [3, 1, 1], "fx": [None], "ex": [1, None, None, 2, 3], "ex1": [3, 1, None, 1],
        "ts": {"p": 3, "q": 1}, "cl": [3, 1, None, 1, 8, None, None], "lift": ["k", "l", None, "y"]}


def test_structs(spark):
    st = d("st")
    got = values(
        spark, f=st.struct.field("q"), m=st.struct.field("z"), r=st.struct.rename_fields(["k"]), w=st.struct.with_fields((st.struct.field("p") + 1).alias("p"), pl.lit(True).alias("t")), j=st.struct.with_fields(N.alias("a")).struct.json_encode(), same=st == {"q": "u", "p": 1}, other=st == {"q": "v", "p": 1},
        inter=pl.concat_list([st]).list.set_intersection([{"q": "u", "p": 1}]), t=pl.lit([1, 2]).cast("string"))
    assert got == {"f": "u", "m": None, "r": {"k": 1, "field_1": "u"}, "w": {"p": 2, "q": "u", "t": True}, "j": '{"a":null,"p":1,"q":"u"}', "same": True, "other": False, "inter": [{"p": 1, "q": "u"}], "t": "[1,2]"}


@pytest.mark.parametrize("bad", [
    lambda: d("s") & True, lambda: d("s") + 1, lambda: d("i") < "a", lambda: d("f") % 2, lambda: d("f").cast("int"), lambda: d("i").cast("bool"), lambda: d("s").cast("int"), lambda: d("i").list.len(), lambda: d("i").str.contains("a"), lambda: d("i").struct.field("x"), lambda: pl.element(),
    lambda: d("st").struct.with_fields(d("i")), lambda: d("xs").list.join(","), lambda: d("nothing")])
def test_type_errors(spark, bad):
    with pytest.raises(ExpressionError):
        values(spark, x=bad())


def test_names_and_serialised_forms(spark):
    for bad in ("plain", "other.x", "src."):
        with pytest.raises(ValueError):
            pl.col(bad)
    with pytest.raises(NotImplementedError):
        values(spark, x=Expr("unheard_of"))
    e = pl.when(d("i") > 3).then(d("xs").list.get(0)).otherwise(None)
    assert values(spark, x=Expr.from_json(e.to_json())) == {"x": 3}
    with pytest.raises(TypeError):
        bool(d("i") > 3)
    for raising in (d("xs").list.get(9), pl.lit(-1).bit_and(1), d("i") % 0, d("xs").list.gather_every(0)):
        with pytest.raises(Exception):  # noqa: B017
            values(spark, x=raising)
    assert values(spark, x=(d("i") == 0) & ((10 % (d("i") - 7)) > 0)) == {"x": False}


def test_states_of_lists_and_structs(spark):
    nodes = spark.createDataFrame([(0, "start", False, []), (1, "transparent", False, []), (2, "gate", True, [("tcp", 80, 80), ("udp", 53, 53)])], "id long, label string, has_rules boolean, allow_rules array<struct<protocol:string,from_port:long,to_port:long>>")
    edges = spark.createDataFrame([(10, 0, 1, 100), (11, 1, 2, 3000)], "id long, src long, dest long, map long")
    rules = pl.col("dest.allow_rules")
    matching = rules.list.filter(pl.col("state.protocols").list.contains(pl.element().struct.field("protocol")))
    r = pl.Graph(nodes, edges).search(
        start_nodes=[0], visit=pl.when(pl.col("dest.has_rules")).then(matching.list.len() > 0).otherwise(True), stop=pl.col("dest.id") == 2, max_depth=2, max_paths=1, intermediate_states=True,
        next_state={"rules": pl.when(pl.col("dest.has_rules")).then(pl.col("state.rules").list.set_intersection(rules)).otherwise(pl.col("state.rules")), "map": pl.col("edge.map"), "guard": pl.when(True).then(1).otherwise(pl.col("dest.label") + 1), "ratio": pl.col("edge.map") / 8},
        initial_state={"protocols": ["tcp"], "rules": [{"to_port": 80, "protocol": "tcp", "from_port": 80}], "map": 0, "guard": 0, "ratio": 0})
    (p,) = r.paths
    assert p.nodes == [0, 1, 2]
    assert p.state == {"protocols": ["tcp"], "rules": [{"to_port": 80, "protocol": "tcp", "from_port": 80}], "map": 3000, "guard": 1, "ratio": 375.0}
    assert [s["map"] for s in p.intermediate_states] == [0, 100, 3000]
