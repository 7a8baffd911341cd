"""Profiles, rules and uploads."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from inkveil.model import DEFAULT_ACTIONS, NAME_BAD_CHARS, NAME_EMPTY, NAME_TOO_LONG
from inkveil.operators import profiles as P
from inkveil.operators import storage
from inkveil.operators import uploads as U
from inkveil.operators.numbering import number_rows

NOW = dt.datetime(2024, 1, 1)


def later():
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


@pytest.fixture(scope="module")
def store(spark):
    return P.default_profile(spark, NOW)


def create(store, requests):
    profiles, rules, next_id = store
    df = profiles.sparkSession.createDataFrame(
        [(i, n, s) for i, (n, s) in enumerate(requests)], "ord long, name string, source string"
    )
    new, new_rules, outcome = P.create_profiles(profiles, rules, df, next_id, later())
    added = new.count()
    return (profiles.unionByName(new), rules.unionByName(new_rules), next_id + added), {
        r.ord: r for r in outcome.collect()
    }


def actions_of(rules, profile_id):
    return {r.pii_type: r.action for r in rules.where(F.col("profile_id") == profile_id).collect()}


def test_default_profile(store):
    profiles, rules, next_id = store
    row = profiles.first()
    assert (row.profile_id, row.name, next_id) == (1, "default", 2)
    assert actions_of(rules, 1) == DEFAULT_ACTIONS


def test_names(spark):
    names = {
        "default": None, "high_privacy": None, "my-profile-1": None, "Test123": None, "a" * 50: None,
        "": NAME_EMPTY, "a" * 51: NAME_TOO_LONG, "test profile": NAME_BAD_CHARS, "test@profile": NAME_BAD_CHARS,
        "name\n": NAME_BAD_CHARS, "é": NAME_BAD_CHARS,
    }
    df = spark.createDataFrame([(n,) for n in names], "name string")
    for r in P.validate_names(df).collect():
        assert r.is_valid == (names[r.name] is None)
        assert r.error == (names[r.name] or "")


def test_lookup(spark, store):
    asked = [(0, None, None), (1, None, "DEFAULT"), (2, 1, "nobody"), (3, None, "1"), (4, 7, None), (5, None, "nobody"), (6, None, "")]
    df = spark.createDataFrame(asked, "i int, profile_id long, profile string")
    got = {r.i: (r.resolved_id, r.error) for r in P.resolve_profile(df, store[0]).collect()}
    assert {i for i, (p, e) in got.items() if p == 1 and e is None} == {0, 1, 2, 3, 6}
    assert got[4] == (None, "Profile not found: 7")
    assert got[5] == (None, "Profile not found: nobody")


def test_create_copy_update_delete(spark, store):
    more, outcome = create(store, [("test", None), ("TEST", None), ("bad name", None), ("other", "nobody"), ("second", "Default")])
    assert outcome[0].profile_id == 2 and outcome[0].error is None
    assert outcome[1].error == "Profile 'TEST' already exists"
    assert outcome[2].error == NAME_BAD_CHARS
    assert outcome[3].error == "Source profile not found: nobody"
    assert outcome[4].profile_id == 3
    profiles, rules, next_id = more
    assert next_id == 4 and actions_of(rules, 2) == DEFAULT_ACTIONS

    changes = spark.createDataFrame(
        [(2, 0, "person_name=delete"), (2, 1, "phone=invent"), (2, 2, "phone=keep_part"),
         (3, 3, "person_name=delete"), (3, 4, "email=invent"), (9, 5, "email=delete")],
        "profile_id int, ord long, change string",
    )
    after, new_rules, done = P.update_rules(profiles, rules, changes, later())
    assert actions_of(new_rules, 2) == {**DEFAULT_ACTIONS, "person_name": "delete", "phone": "keep_part"}
    assert actions_of(new_rules, 3) == DEFAULT_ACTIONS  # all or nothing
    errors = {r.ord: (r.applied, r.error) for r in done.collect()}
    assert errors[0] == (True, None) and errors[3] == (False, None)
    assert errors[4] == (False, "Invalid action 'invent' for email. Valid: ['delete', 'keep_part']")
    assert errors[5] == (False, "Profile not found: 9")
    stamps = {r.profile_id: r.modified_at for r in after.collect()}
    assert stamps[2] == dt.datetime(2024, 2, 1) and stamps[1] == NOW
    assert {r.change for r in P.diff_rules(rules, new_rules).collect()} == {
        "person_name (keep_part → delete)", "phone (delete → keep_part)"
    }

    # a copy takes the changed rules along
    (_, copied, _), made = create((after, new_rules, next_id), [("copy", "test")])
    assert made[0].profile_id == 4
    assert actions_of(copied, 4) == actions_of(new_rules, 2)

    asked = spark.createDataFrame([(None, "default"), (2, None), (None, "nobody")], "profile_id long, profile string")
    left, left_rules, out = P.delete_profiles(after, new_rules, asked)
    assert {r.profile_id for r in left.collect()} == {1, 3}
    assert {r.profile_id for r in left_rules.collect()} == {1, 3}
    assert {r.error for r in out.collect()} == {None, "Cannot delete the default profile", "Profile not found: nobody"}


def test_numeric_names(spark):
    """A name in digits is found by name first; only without such a name it is an id."""
    profiles = spark.createDataFrame(
        [(1, "default", NOW, NOW), (2, "123", NOW, NOW), (3, "2", NOW, NOW), (123, "x", NOW, NOW)],
        "profile_id int, name string, created_at timestamp, modified_at timestamp",
    )
    asked = [(0, None, "123"), (1, None, "2"), (2, None, "3"), (3, 2, None), (4, 123, None), (5, None, "77")]
    got = P.resolve_profile(spark.createDataFrame(asked, "i int, profile_id long, profile string"), profiles).collect()
    assert {r.i: r.resolved_id for r in got} == {0: 2, 1: 3, 2: 3, 3: 2, 4: 123, 5: None}
    assert len(got) == len(asked)


def test_change_of_an_absent_rule(spark, store):
    profiles, rules, _ = store
    changes = spark.createDataFrame([(1, 0, "email=delete")], "profile_id int, ord long, change string")
    _, new_rules, done = P.update_rules(profiles, rules.where("pii_type <> 'email'"), changes, later())
    assert done.first().applied
    assert actions_of(new_rules, 1) == {**DEFAULT_ACTIONS, "email": "delete"}


def test_missing_and_illegal_rules(spark):
    profiles = spark.createDataFrame([(1, "none"), (2, "one"), (3, "bad")], "profile_id int, name string")
    rules = spark.createDataFrame(
        [(2, "email", "delete", None), (3, "email", "invent", None), (3, "phone", "delete", None)],
        "profile_id int, pii_type string, action string, description string",
    )
    got = {r.profile_id: r for r in P.with_rules(profiles, rules).collect()}
    assert {t: got[1][f"action_{t}"] for t in DEFAULT_ACTIONS} == DEFAULT_ACTIONS
    assert got[2].action_email == "delete" and got[2].action_phone == DEFAULT_ACTIONS["phone"]
    assert [got[k].rule_error for k in (1, 2, 3)] == [None, None, "Invalid action 'invent' for email"]


def test_incomplete_snapshot(spark, store, tmp_path):
    profiles, rules, next_id = store
    for k, part in enumerate(("profiles", "rules", "next_id")):
        path = tmp_path / f"v{k}"
        P.save_profiles(profiles, rules, next_id, str(path))
        (path / part).rename(path / "gone")
        with pytest.raises(ValueError, match=part):
            P.load_profiles(spark, str(path), NOW)


def test_salt_is_needed(spark):
    from inkveil.operators.actions import sanitize_documents

    df = spark.createDataFrame([(1, "x")], "doc_id int, text string")
    with pytest.raises(ValueError, match="salt"):
        sanitize_documents(df, {"phone": "invent"})
    sanitize_documents(df, {"phone": "delete"})


def test_numbering_of_sparse_values(spark):
    """Values far apart do not make a range each."""
    rows = spark.range(20_000).select((F.col("id") * 1_000_003 * 977).alias("ord"))
    out = number_rows(rows, "ord", 5, "n")
    assert out.where("n <> ord / (1000003 * 977) + 5").count() == 0
    assert out.agg(F.min("n"), F.max("n"), F.countDistinct("n")).first() == (5, 20_004, 20_000)


def test_persistence(spark, store, tmp_path):
    profiles, rules, next_id = store
    P.save_profiles(profiles, rules, next_id, str(tmp_path / "v1"))
    p, r, n = P.load_profiles(spark, str(tmp_path / "v1"), NOW)
    assert n == 2 and actions_of(r, 1) == DEFAULT_ACTIONS and p.first().created_at == NOW
    p, r, n = P.load_profiles(spark, str(tmp_path / "none"), NOW)
    assert n == 2 and p.first().name == "default"


def test_json_store(spark, tmp_path):
    config = {t: {"action": a, "description": None} for t, a in DEFAULT_ACTIONS.items() if t != "email"}
    config["phone"] = {"action": "invent", "description": "own"}
    store = {"profiles": [{
        "id": 4, "name": "x", "created_at": "2024-01-01T10:00:00Z", "modified_at": "2024-01-02T10:00:00.5Z", "config": config,
    }], "next_id": 5}
    path = tmp_path / "profiles.json"
    path.write_text(json.dumps(store, indent=2))
    p, r, n = P.load_profile_json(spark, str(path), NOW)
    assert n == 5 and p.first().modified_at == dt.datetime(2024, 1, 2, 10, 0, 0, 500000)
    assert actions_of(r, 4) == {**DEFAULT_ACTIONS, "phone": "invent"}
    texts = {x.pii_type: x.description for x in P.summarize_rules(r, ["profile_id"]).collect()}
    assert texts["phone"] == "own" and texts["email"].startswith("Keep domain only")
    assert P.load_profile_json(spark, str(tmp_path / "none.json"), NOW)[2] == 2
    path.write_text("{broken")
    with pytest.raises(Exception):
        P.load_profile_json(spark, str(path), NOW)[0].collect()


def test_number_rows_over_many_ranges(spark):
    df = spark.range(0, 1_000_000, 7).select((F.col("id") * 13).alias("ord"))
    out = number_rows(df, "ord", 5, "n")
    checked = out.select(F.max("n"), F.min("n"), F.countDistinct("n"), F.count_if(F.col("n") != F.col("ord") / 91 + 5)).first()
    assert list(checked) == [142_857 + 5, 5, 142_858, 0]


def test_uploads(spark, tmp_path):
    files = spark.createDataFrame([("a.TXT", bytearray(b"abc")), ("noext", bytearray(b"")), (".txt", bytearray(b"x"))], "filename string, content binary")
    path = str(tmp_path / "uploads")
    kept = U.register_uploads(files, path, f"{tmp_path}/store/")
    rows = {r.filename: r for r in kept.collect()}
    assert rows["a.TXT"].size == 3 and rows["a.TXT"].path == f"{tmp_path}/store/{rows['a.TXT'].file_id}.txt"
    assert rows["noext"].path.endswith(rows["noext"].file_id) and rows[".txt"].path.endswith(rows[".txt"].file_id)
    assert {r.file_id for r in kept.collect()} == {r.file_id for r in spark.read.parquet(path).collect()}

    wanted = spark.createDataFrame([(rows["a.TXT"].file_id,), ("../etc/passwd",)], "file_id string")
    found, missing = U.get_uploads(kept, wanted)
    assert [r.filename for r in found.collect()] == ["a.TXT"]
    assert [r.file_id for r in missing.collect()] == ["../etc/passwd"]
    left, outcome = U.delete_uploads(kept, wanted)
    assert left.count() == 2 and {r.deleted for r in outcome.collect()} == {True, False}

    made = kept.withColumn("created_at", F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    at = lambda s: F.to_timestamp(F.lit(f"2024-01-01 00:05:0{s}"))
    assert U.expire(made, at(0))[1].count() == 0  # exactly the limit stays
    assert U.expire(made, at(1))[1].count() == 3
    listing = made.select(F.concat(F.lit("/x/"), "path").alias("path"), F.col("created_at").alias("modificationTime"))
    assert U.orphans(listing, made, at(1)).count() == 0
    assert U.orphans(listing, made.where(F.col("filename") != "a.TXT"), at(1)).count() == 1


def test_contents_are_sent_on_together_up_to_a_bound(spark, tmp_path, monkeypatch):
    files = [(str(i), bytearray(b"x" * (i * 100))) for i in range(40)] + [("none", None)]
    df = spark.createDataFrame(files, "filename string, content binary").coalesce(1)
    kept = U.register_uploads(df, f"{tmp_path}/u").coalesce(1)
    for held, most in ((4 << 20, 2), (1, 41)):  # arrow batches hold 64 rows
        monkeypatch.setattr(storage, "HELD", held)
        frame = storage.read_contents(kept)
        assert {r.filename: r.content and len(r.content) for r in frame.collect()} == {n: c and len(c) for n, c in files}
        sent = []

        class Caught(Exception):
            pass

        def catch(self, get, schema):
            sent.append(get)
            raise Caught

        with monkeypatch.context() as m:
            m.setattr(type(kept), "mapInArrow", catch)
            with pytest.raises(Caught):
                storage.read_contents(kept)
        assert 1 <= len(list(sent[0](iter(kept.toArrow().to_batches())))) <= most


def test_stored_uploads_are_read_after_the_join(spark, sf_dir):
    import __spark_entry__ as entry

    plan = entry.queries()["stored_uploads"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Join")


def test_files_of_uploads(spark, tmp_path):
    files = [("a b.TXT", b"abc"), ("noext", b""), (None, b"x" * 100_000), ("gone.csv", None)]
    df = spark.createDataFrame([(n, None if c is None else bytearray(c)) for n, c in files], "filename string, content binary")
    path = f"{tmp_path}/up loads"
    kept = U.register_uploads(df, path)
    again = U.register_uploads(df.where("filename = 'noext'"), path)
    assert again.count() == 5 and set(again.columns) == {"file_id", "filename", "size", "created_at", "path"}
    on_disk = {p.name for p in (tmp_path / "up loads-files").iterdir()}
    assert on_disk == {r.path.split("/")[-1] for r in again.collect() if r.path}
    got = sorted((r.filename or "", None if r.content is None else bytes(r.content), r.size) for r in storage.read_contents(again).collect())
    assert got == sorted([(n or "", c, None if c is None else len(c)) for n, c in files] + [("noext", b"", 0)], key=lambda x: x[0])

    # A task that runs again: the same file once more, nothing beside it.
    twice = kept.where("size = 3").withColumn("content", F.lit(b"abc"))
    assert storage.write_files(twice.unionAll(twice)).count() == 2
    assert {p.name for p in (tmp_path / "up loads-files").iterdir()} == on_disk

    listed = spark.read.format("binaryFile").load(f"{path}-files").select("path", "modificationTime")
    late = F.current_timestamp() + F.expr("INTERVAL 1 DAY")
    lost = U.orphans(listed, kept.where("size = 3"), late)
    assert [r.removed for r in storage.remove_files(lost).collect()] == [True]
    assert [r.removed for r in storage.remove_files(kept.where("size > 3 or path is null")).collect()] == [False, False]
    assert storage.read_contents(kept).where("content is not null").count() == 2
