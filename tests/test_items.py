"""Operators on small literal rows."""

import hashlib

from pyspark.sql import functions as F

from itemlake import model
from itemlake.functions import paths, policy
from itemlake.operators import merkle, search, store, views


def ids(df, col="object_id"):
    return sorted(r[0] for r in df.select(col).collect())


TOOLS = [
    ("shop:tools:1", '{"label":"Red Hammer","weight":3,"uses":["nails","wood"]}'),
    ("shop:tools:2", '{"label":"Long Saw","weight":11,"uses":["wood"]}'),
    ("shop:tools:3", '{"label":"Iron Vice","weight":19,"uses":["metal"],"weight_text":"19"}'),
    ("shop:tools:4", '{"label":"Tape","uses":"nails"}'),
    ("shop:tools:5", None),
]


def test_search(spark):
    tools = spark.createDataFrame(TOOLS, "object_id string, payload string")
    found = lambda *a: [i[-1] for i in ids(search.search(tools, *a))]
    assert found(search.text_eq("label", "Red Hammer")) == ["1"]
    assert found(search.between("weight", 10, 20)) == ["2", "3"]
    assert found(search.tags("uses", "nails")) == ["1", "4"]
    assert found(search.tags("uses", "wood") & search.between("weight", 10)) == ["2"]
    assert found(search.numeric_eq("weight_text", 19)) == []
    assert found(~search.between("weight", 10, 20)) == ["1"]
    assert "4" in found(~search.between("weight", 10, 20), search.Dialect(hot=True))
    assert found(search.text_eq("label", "hammer RED"), search.Dialect(hot=True)) == ["1"]
    assert ids(search.search(tools, search.ALL, limit=2)) == ["shop:tools:1", "shop:tools:2"]


def test_nearest_goes_by_the_whole_distance(spark):
    items = spark.createDataFrame([("a", "{}", [1.0000003, 0.0]), ("z", "{}", [1.0, 0.0])], "object_id string, payload string, vector array<double>")
    assert [r.object_id for r in search.nearest(items, [1.0, 0.0], 1).collect()] == ["z"]


def test_upsert_takes_the_last_of_several_changes(spark):
    base = spark.createDataFrame([("a", 1, "x")], "object_id string, version long, content_hash string")
    new = spark.createDataFrame([("a", 2, "y"), ("a", 3, "z"), ("b", 1, "x")], "object_id string, version long, content_hash string")
    assert sorted(tuple(r) for r in store.upsert(base, new).collect()) == [("a", 3, "z", True), ("b", 1, "x", True)]


def test_update_equals_build_where_an_id_has_children(spark):
    leaf = lambda rows: spark.createDataFrame(rows, "path string, hash string")
    rows = [("a", "aa"), ("a.b", "bb"), ("c.d", "cc")]
    deleted = leaf([("a.b", "")]).select("path")
    got = merkle.update(merkle.build(leaf(rows)), leaf([]), deleted)
    assert sorted(got.collect()) == sorted(merkle.build(leaf([rows[0], rows[2]])).collect())
    gone = merkle.update(merkle.build(leaf(rows)), leaf([]), leaf(rows).select("path"))
    assert gone.count() == merkle.build(leaf([])).count() == 0


def test_nearest_breaks_ties_by_id(spark):
    items = spark.createDataFrame([("b", "{}", [1.0, 0.0]), ("a", "{}", [1.0, 0.0]), ("c", "{}", [0.0, 1.0])], "object_id string, payload string, vector array<float>")
    for metric in ("l2", "ip", "cosine"):
        assert [r.object_id for r in search.nearest(items, [1.0, 0.0], 2, metric).collect()] == ["a", "b"]


def test_content_type(spark):
    cases = {"{}": "json", "[1]": "json", '"s"': "json", " {}": "json", "12": "binary", "": "binary", "{bad": "binary", "null": "binary"}
    df = spark.createDataFrame([(k,) for k in [*cases, None]], "t string")
    assert dict(df.select("t", model.content_type(F.col("t"))).collect()) == cases | {None: "binary"}


def test_hashes_equal_hashlib(spark):
    digest = hashlib.sha256(b"{}").hexdigest()
    df = spark.createDataFrame([("a.b", 300, digest), ("a.c", 1, digest), ("d", 2**40, digest)], "object_id string, version long, content_hash string")
    nodes = {r.path: r for r in merkle.build(merkle.leaves(df)).collect()}
    leaf = {p: hashlib.sha256(p.encode() + b"|" + v.to_bytes(8, "little") + b"|" + bytes.fromhex(digest)).digest() for p, v, _ in df.collect()}
    a = hashlib.sha256(b"b:" + leaf["a.b"] + b";" + b"c:" + leaf["a.c"] + b";").digest()
    root = hashlib.sha256(b"a:" + a + b";" + b"d:" + leaf["d"] + b";").hexdigest()
    assert nodes["a.b"].merkle_hash == leaf["a.b"].hex() and nodes["a"].merkle_hash == a.hex() and nodes[""].merkle_hash == root
    assert nodes["a"].object_count == 2 and nodes["d"].is_leaf and nodes[""].parent_path is None


def test_upsert_marks_dirty(spark):
    base = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x")], "object_id string, version long, content_hash string")
    new = spark.createDataFrame([("a", 1, "x"), ("b", 2, "x"), ("c", 1, "y")], "object_id string, version long, content_hash string")
    assert {r.object_id: r.merkle_dirty for r in store.upsert(base, new).collect()} == {"a": False, "b": True, "c": True}


def test_routes_and_paths(spark):
    routes = {"view:": "v", "view:users:": "users"}
    df = spark.createDataFrame([("view:users:1",), ("view:x",), ("misc",)], "k string")
    assert [r[0] for r in df.select(store.route(F.col("k"), routes)).collect()] == ["users", "v", "sync_items"]
    one = spark.createDataFrame([("farm.barn.cow",)], "p string").select(paths.ancestors(F.col("p")), paths.parent(F.col("p")), paths.last_segment(F.col("p"))).first()
    assert tuple(one) == (["farm", "farm.barn", "farm.barn.cow"], "farm.barn", "cow")


def test_policy_bounds(spark):
    df = spark.createDataFrame([(90,), (91,), (450,), (451,), (864000,), (864001,)], "s long")
    assert [r[0] for r in df.select(policy.snapped_ttl(F.col("s"))).collect()] == [60, 300, 300, 900, 604800, 864001]
    used = spark.createDataFrame([(0.75,), (0.85,), (0.95,)], "u double")
    assert [round(r[0], 6) for r in used.select(policy.keep_multiplier(F.col("u"))).collect()][::2] == [1.0, 0.0]


def test_cdc_replay(spark):
    log = spark.createDataFrame([(1, "PUT", "a", "h1", "p", 1), (2, "PUT", "b", "h2", "p", 2), (3, "DEL", "a", None, None, 3)], "seq long, op string, object_id string, content_hash string, payload string, updated_at long")
    assert ids(store.apply_cdc(store.cdc_log(log)), "key") == ["b"]


def test_typed_view_pushes_filters_to_the_scan(spark, tmp_path, capsys):
    tools = spark.createDataFrame(TOOLS, "object_id string, payload string").withColumn("updated_at", F.lit(1))
    fields = [views.Field("label", "text"), views.Field("weight", "number"), views.Field("uses", "tags"), views.Field("weight_text", "number")]
    views.typed(tools, *fields).write.parquet(f"{tmp_path}/view")
    view = spark.read.parquet(f"{tmp_path}/view")
    assert ids(view.filter("weight_text is not null")) == []
    found = search.search(view, search.between("weight", 10, 20) & search.tags("uses", "wood"), views.Typed())
    assert ids(found) == ["shop:tools:2"]
    found.explain("formatted")
    assert "GreaterThanOrEqual(weight,10.0)" in capsys.readouterr().out


def test_typed_view_of_places_and_vectors(spark):
    rows = [("a", '{"at":"16.4,48.2","v":[1,2]}'), ("b", '{"at":"north","v":[1,2,3]}'), ("c", '{"at":"500,0","v":"x"}'), ("d", None), ("e", '{"at":"1"}')]
    items = spark.createDataFrame(rows, "object_id string, payload string").withColumn("updated_at", F.lit(1))
    view = views.typed(items, views.Field("at", "geo"), views.Field("v", "vector", dim=2))
    assert ids(view.filter("at is not null")) == ["a"] and ids(view.filter("v is not null")) == ["a"]
    assert ids(view.filter(views.metres(F.col("at"), 16.4, 48.2) < 1)) == ["a"]


def test_drill_down_where_one_side_has_children(spark):
    tree = lambda *rows: merkle.build(spark.createDataFrame(rows, "path string, hash string"))
    h = [hashlib.sha256(bytes([i])).hexdigest() for i in range(4)]
    ours, theirs = tree(("a", h[0]), ("b.x", h[1]), ("c.y", h[2])), tree(("a.k", h[3]), ("b.x", h[1]), ("c.y", h[0]), ("d.z.w", h[1]))
    got = {tuple(r) for r in merkle.drill_down(ours, theirs).collect()}
    assert got == {("a", "local_only"), ("a.k", "remote_only"), ("c.y", "divergent"), ("d.z.w", "remote_only")}
    assert merkle.drill_down(ours, ours).count() == 0


def test_applied_entries_lead_to_the_other_state(spark):
    schema = "object_id string, content_hash string, version long, content_type string, updated_at long"
    before = spark.createDataFrame([("a", "1", 1, "json", 1), ("b", "2", 1, "json", 1), ("c", None, 1, "json", 1)], schema)
    after = spark.createDataFrame([("a", "9", 2, "binary", 5), ("c", None, 7, "json", 9), ("d", "4", 1, "json", 1), ("e", None, 1, "json", 1)], schema)
    entries = store.emitted(before, after)
    assert sorted((r.op, r.key) for r in entries.collect()) == [("DEL", "b"), ("PUT", "a"), ("PUT", "d"), ("PUT", "e")]
    got = sorted(tuple(r) for r in store.applied(before, entries).collect())
    assert got == [("a", "9", 2, "binary", 5, True), ("c", None, 1, "json", 1, False), ("d", "4", 1, "json", 1, True), ("e", None, 1, "json", 1, True)]
