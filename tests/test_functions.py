"""Labels, reports, text and token functions on literals and against small models."""

import bz2
import gzip
import io
import json
import lzma
import random
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from samplemill.functions import reports, text, tokens, votes
from samplemill.operators import features, packing
from samplemill.operators.sections import section_bounds
from samplemill.sources import archives, files, labels, logs, payloads, sinks


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'binary' if isinstance(v, bytes) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


def test_vote_lines(spark):
    lines = [
        ("s1 12 CLASS:grayware|3,CLASS:grayware:adware|4,FAM:zlob|2,FAM:vundo|9,BEH:spam|1",),
        ("s2 x []",),
        ("s3 4 SINGLETON:abc",),
        ("s4 7",),
    ]
    items = labels.vote_items(spark.createDataFrame(lines, "value string"))
    got = {r.id: r for r in items.collect()}
    assert (got["s1"].flagged, got["s2"].flagged) == (12, 0)
    assert got["s2"].votes is got["s3"].votes is got["s4"].votes is None
    table = {(r.id, r.ns, r.value): r["count"] for r in labels.vote_table(items).collect()}
    assert table == {
        ("s1", "class", "grayware"): 7, ("s1", "class", "adware"): 4, ("s1", "fam", "zlob"): 2,
        ("s1", "fam", "vundo"): 9, ("s1", "beh", "spam"): 1,
    }
    label = {r.id: r.label for r in labels.resolved_labels(items).collect()}["s1"]
    assert (label["class"], label["fam"], label["beh"], label["vuln"]) == (["grayware"], ["vundo"], None, None)
    wide = {r.id: r.label for r in labels.resolved_labels(items, {ns: (None, None) for ns in votes.NAMESPACES}).collect()}["s1"]
    assert wide["class"] == ["grayware", "adware"] and wide["fam"] == ["vundo", "zlob"]
    assert [r.id for r in labels.view(labels.resolved_labels(items), "fam").collect()] == ["s1"]


def test_family_lines(spark):
    lines = spark.createDataFrame([("a  zlob",), ("b - []",), ("c SINGLETON:c",)], "value string")
    assert {r.id: r.family for r in labels.family_labels(lines).collect()} == {"a": "zlob", "b": None, "c": None}
    with pytest.raises(Exception, match="unexpected line"):
        labels.family_labels(spark.createDataFrame([("a b c d",)], "value string")).collect()


def test_threat_reports(spark):
    report = {
        "data": {"attributes": {
            "last_submission_date": 9, "last_modification_date": 5,
            "popular_threat_classification": {
                "suggested_threat_label": "trojan.x",
                "popular_threat_name": [{"value": "p", "count": 1}, {"value": "q", "count": 3}, {"value": "r", "count": 3}],
            },
        }}
    }
    df = spark.createDataFrame([("a", json.dumps(report)), ("b", "{broken"), ("c", '{"data":{}}')], "id string, text string")
    def run(*args):
        return {r.id: r.labels for r in labels.report_labels(df, *args).collect()}
    assert run("name") == {"a": ["q", "r", "p"], "b": None, "c": None}
    assert run("name", "top", 1)["a"] == ["q"]
    assert run("name", "vote", 3)["a"] == ["q", "r"]
    assert run("label") == {"a": ["trojan.x"], "b": None, "c": None}
    assert run("category")["a"] is None
    seen = df.select("id", reports.earliest_sighting("text").alias("t")).collect()
    assert {r.id: r.t for r in seen} == {"a": 5, "b": None, "c": None}


def nest(leaf, depth):
    return leaf if depth == 0 else {"values": [nest(leaf, depth - 1)]}


def test_scanner_reports_of_any_depth(spark):
    def report(*values):
        return "log line\n" + json.dumps({"detects": [{"values": list(values)}]}) + " end"

    packer = {"type": "Packer", "name": "UPX"}
    rows = [
        ("a", "recursive", report(nest(packer, 13), {"type": "Compiler", "name": "gcc"})),
        ("a", "deep", report({"type": "Library", "name": "x"})),
        ("b", "recursive", report(nest({"type": "Cryptor", "name": "Cryptor detected"}, 2), {"type": "Packer", "name": ""})),
        ("c", "recursive", None),
        ("c", "deep", ""),
        ("c", "heuristic", '{"detects": ['),
        ("d", "deep", '{"other": 1}'),
    ]
    df = spark.createDataFrame(rows, "id string, mode string, raw string")
    states = [r.s for r in df.select(reports.body_state("raw").alias("s")).collect()]
    assert states == ["ok", "ok", "ok", "missing", "empty", "broken", "ok"]
    flags = packing.consolidate(df, "id", "mode", "raw")
    got = {(r.id, r.mode): (r.is_obfuscated, r.packers) for r in flags.collect()}
    assert got[("a", "recursive")] == (True, ["UPX"])
    assert got[("a", "deep")] == (False, [])
    assert got[("b", "recursive")] == (True, ["Generic"])
    assert got[("c", "heuristic")] == (None, None)
    assert got[("d", "deep")] == (False, [])
    packed = {r.id: r.is_packed for r in packing.packing_map(flags, "id", "mode").collect()}
    assert packed == {"a": True, "b": True, "c": None, "d": False}
    loose = packing.packing_map(flags, "id", "mode", null_is_unknown=False)
    assert {r.id: r.is_packed for r in loose.collect()}["c"] is False


def test_text_functions(spark):
    assert one(spark, text.without_block_comments("t"), t="a/* x\ny */b/**/c/*d") == "abc/*d"
    assert one(spark, text.instructions("t"), t="head\n.text\t0\t1\tAA\t mov eax \n\nx\ty") == "mov eax\ny"
    assert one(spark, text.without_signatures("t"), t="sig\na\nb\n\nsig2\nc\n\nlone") == "a\nb\n\nc\n\n"
    assert one(spark, text.to_ascii("t"), t="Éçà ß ł Ø → ÿ") == "Eca ss l O  y"
    assert one(spark, text.collapse_runs("t", 3), t="aaab\n\n\ncc") == "ab\ncc"
    assert bytes(one(spark, text.collapse_byte_runs("t", 2), t=b"\x00\x00\x01\n\n\xff\xff")) == b"\x00\x01\n\n\xff"
    shown = one(spark, text.printable_bytes("t"), t=bytes(range(256)))
    assert shown == "".join(chr(10752 + b) for b in range(256))


def capitalized(line):
    """The character machine, one character at a time."""
    out, history, in_hex, in_fun = [], "", False, False
    for char in line:
        history = (history + char)[-4:]
        if history[-2:] == "0x":
            in_hex = True
        elif history == "fun_":
            in_fun = True
        elif in_hex and not char.isalnum():
            in_hex = False
        elif not in_hex and in_fun and char == "(":
            in_fun = False
        elif in_hex or in_fun:
            char = char.upper()
        out.append(char)
    return "".join(out)


def test_capitalize_hex(spark):
    rng = random.Random(2)
    lines = ["mov eax,0x1fab", "call fun_00ab12cd(eax)", "0x10xff 0xz-a"]
    lines += [" ".join(rng.choice(["add", "0xab1c", "fun_00ff(", "ff", "[0x1f+ebx]"]) for _ in range(12)) for _ in range(20)]
    parts = ["fun_", "0x", "ab", "(", "mov", "_", "fun", "x", "0", " ", "é", "f", "1F", ")"]
    lines += ["".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(3000)]
    df = spark.createDataFrame([(x,) for x in lines], "t string")
    assert [r.x for r in df.select(text.capitalize_hex("t").alias("x")).collect()] == [capitalized(x) for x in lines]


def test_capitalize_hex_looks_only_at_runs(spark):
    segments = lambda t: one(spark, F.regexp_extract_all("t", F.lit(text.SEGMENTS), F.lit(0)), t=t)
    plain = "add f0 (fun) of 0 words, " * 5000
    assert segments(plain) == [plain]
    assert segments("a 0xfun_1(2)(3 fun_4 0x5(6)7(8") == ["a ", "0xfun_1(2)", "(3 ", "fun_4 0x5(6)7", "(8"]
    marked = "fun_" + "ab0x1 (ⓐ" * 50_000
    assert one(spark, text.capitalize_hex("t"), t=marked) == "fun_" + "AB0x1 (ⓐ" + "ab0x1 (ⓐ" * 49_999


def test_byte_ids(spark):
    data = bytes([0x12, 0x34, 0x56, 0xFF])
    assert one(spark, tokens.byte_ids("b", 8), b=data) == list(data)
    assert one(spark, tokens.byte_ids("b", 16), b=data[:3]) == [0x3412, 0x0056]
    assert one(spark, tokens.byte_ids("b", 12), b=data) == [0x123, 0x456, 0xFF0, 0x000]


def test_input_ids_and_padding(spark):
    ids = F.array(*[F.lit(i) for i in range(6)])
    row = spark.range(1).select(
        tokens.input_ids(ids, 7, 4, bos=3, eos=4).alias("a"), tokens.input_ids(ids, cls=5).alias("b"),
        tokens.padded(ids, 8, 9).alias("c"), tokens.padded(ids, 2).alias("d"), tokens.padded_to_multiple(ids, 4).alias("e"),
        tokens.windows(ids, 4, 1).alias("f"), tokens.chunk_index(ids, 4).alias("g"), tokens.multi_hot(ids, 3).alias("h"),
        tokens.with_template(ids, ids, None, 4).alias("i"),
    ).first()
    assert row.a == [3, 7, 8, 4] and row.b == [5, 0, 1, 2, 3, 4, 5]
    assert row.c == [0, 1, 2, 3, 4, 5, 9, 9] and row.d == [0, 1] and len(row.e) == 8
    assert row.f == [[0, 1, 2, 3], [3, 4, 5]] and row.g == [0, 0, 0, 0, 1, 1] and row.h == [1.0, 1.0, 1.0]
    assert row.i == [*range(6), 4, 6, *range(6), 4]
    with pytest.raises(ValueError):
        tokens.input_ids(ids, cls=5, bos=3)


def test_listing_tokens(spark):
    assert one(spark, tokens.listing_tokens("t"), t="mov eax,0x1F\n\tfun_A(b)") == [
        "mov", "eax", ",", "0x", "1", "F", "fun_", "A", "(", "b", ")",
    ]


def entropy_model(data):
    """One window at a time, as defined."""
    a = np.frombuffer(data, dtype=np.uint8)
    out = np.zeros((16, 16), dtype=int)
    blocks = [a] if len(a) < 2048 else [a[i : i + 2048] for i in range(0, len(a) - 2047, 1024)]
    for block in blocks:
        c = np.bincount(block >> 4, minlength=16)
        p = c[c > 0].astype(np.float32) / 2048
        level = min(int(np.sum(-p * np.log2(p)) * 4), 15)
        out[level] += c
    return out.reshape(-1).tolist()


def test_byte_entropy_histogram(spark):
    rng = np.random.default_rng(4)
    data = [b"", b"abc" * 10, bytes(range(256)) * 8, rng.integers(0, 256, 5000, dtype=np.uint8).tobytes(), b"\x00" * 3000, b"ab" * 1024 + b"z" * 700]
    df = spark.createDataFrame([(d,) for d in data], "b binary")
    got = [r.x for r in df.select(features.byte_entropy_histogram("b").alias("x")).collect()]
    assert got == [entropy_model(d) for d in data]


def test_string_features(spark):
    df = spark.createDataFrame([(b"\x00hello world\x01abcd\xffC:\\dir http://x MZ\x00",), (b"\x00\x01",)], "b binary")
    first, second = features.string_features(df, "b").collect()
    assert (first.numstrings, first.printables, first.paths, first.urls, first.mz, first.registry) == (2, 29, 1, 1, 1, 0)
    assert sum(first.printabledist) == pytest.approx(1.0) and first.avlength == pytest.approx(14.5)
    assert (second.numstrings, second.avlength, second.entropy) == (0, 0.0, 0.0)


def test_section_codes(spark):
    rows = [
        ("ok", 1, 0, 10, True, 100), ("ok", 2, 10, 5, False, 100),
        ("file", 1, 90, 20, True, 100),
        ("next", 1, 0, 50, True, 100), ("next", 2, 20, 0, True, 100), ("next", 3, 30, 5, False, 100),
        ("empty", 1, 30, 9, True, 100), ("empty", 2, 30, 5, False, 100),
        ("inverted", 1, 30, 9, True, 100), ("inverted", 2, 20, 5, False, 100),
        ("noexec", 1, 0, 9, False, 100),
        ("hollow", 1, 0, 0, True, 100),
        ("none", None, None, None, None, 100),
    ]
    df = spark.createDataFrame(rows, "file string, ord int, offset bigint, size bigint, is_executable boolean, file_length bigint")
    got = {r.file: ([tuple(b) for b in r.bounds], r.code) for r in section_bounds(df).collect()}
    assert got == {
        "ok": ([(0, 10)], 1), "file": ([(90, 100)], 32), "next": ([(0, 30)], 64), "empty": ([], 64 | 128),
        "inverted": ([], 64 | 256), "noexec": ([], 16), "hollow": ([], 8), "none": ([], 4),
    }


def test_payload_codecs_and_policies(spark):
    plain = b"This is a test string."
    made = {"none": plain, "gzip": gzip.compress(plain), "bz2": bz2.compress(plain), "xz": lzma.compress(plain), "zlib": zlib.compress(plain)}
    df = spark.createDataFrame(list(made.items()), "id string, content binary")
    for r in payloads.decoded(df, "id", "content").collect():
        assert (r.alg, bytes(r.bytes), r.error) == (r.id, plain, None)
    assert payloads.decoded(df, "id", "content", max_length=5).count() == 0
    bad = spark.createDataFrame([("x", gzip.compress(plain)[:12]), ("y", plain)], "id string, content binary")
    assert [r.id for r in payloads.decoded(bad, "id", "content", "skip").collect()] == ["y"]
    assert {r.id: bytes(r.bytes) for r in payloads.decoded(bad, "id", "content", "empty").collect()} == {"x": b"", "y": plain}
    with pytest.raises(Exception, match="x "):
        payloads.decoded(bad, "id", "content").collect()


def test_zip_archives(spark, tmp_path):
    content = {"b1.exe": b"x" * 10, "a2.exe": b"yy", "c3.exe": b""}
    for stem in ("aa", "bb"):
        with zipfile.ZipFile(tmp_path / f"{stem}.zip", "w") as z:
            for n, c in content.items():
                z.writestr(n, c)
    (tmp_path / "other.txt").write_text("no archive")
    for scan in (archives.read_archives, archives.scan_members):
        rows = scan(spark, str(tmp_path)).collect()
        assert sorted((r.name, bytes(r.bytes)) for r in rows) == sorted(list(content.items()) * 2)
        assert all(r.bytes is None for r in scan(spark, str(tmp_path), names_only=True).collect())
        assert max(len(r.bytes) for r in scan(spark, str(tmp_path), max_length=3).collect()) == 3
    split = archives.scan_members(spark, str(tmp_path), partitionbytes="2")
    assert split.rdd.getNumPartitions() == 6 and split.count() == 6
    wanted = spark.createDataFrame([("b1.exe", 7)], "name string, label int")
    rows = archives.read_archives(spark, str(tmp_path)).withColumn("archive", F.lit("z"))
    assert archives.requested_members(rows, wanted.withColumn("archive", F.lit("z"))).count() == 2


def test_files_and_maps(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "deep" / "s1.part.exe").write_bytes(b"12345")
    rows = files.binary_files(spark, str(tmp_path / "in"), "*.exe", max_length=2).collect()
    assert [(r.id, r.size, bytes(r.bytes)) for r in rows] == [("s1", 5, b"12")]
    (tmp_path / "one.json").write_text('{"a": 1, "b": 2}')
    (tmp_path / "two.json").write_text('{"b": null, "c": 3}')
    merged = files.read_id_map(spark, [str(tmp_path / "one.json"), str(tmp_path / "two.json")])
    assert {r.id: r.value for r in merged.collect()} == {"a": 1, "b": None, "c": 3}
    (tmp_path / "fam.csv").write_text("sha,ts,family\na,2020,zlob\nb,2020,Unknown\nc,2020,\n")
    assert [r.id for r in files.read_family_labels(spark, str(tmp_path / "fam.csv")).collect()] == ["a"]


def test_report_files(spark, tmp_path):
    (tmp_path / "s1.json").write_text('{\n"data": {"attributes": {"popular_threat_classification":\n{"suggested_threat_label": "x"}}}}')
    (tmp_path / "s2.json").write_text("{\nbroken")
    reports_ = files.read_texts(spark, str(tmp_path), "*.json")
    assert {r.id: r.labels for r in labels.report_labels(reports_).collect()} == {"s1": ["x"], "s2": None}


def test_sweep_and_training_logs(spark, tmp_path):
    lines = ['{"kwds":{"k":1},"results":"ValueError"}', '{"kwds":{"k":2},"results":{"n_to":5}}', "junk"]
    rows = logs.sweep_rows(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert [r.error for r in logs.sweep_errors(rows).collect()] == ["ValueError"]
    assert [tuple(r) for r in logs.sweep_table(rows, {"k": "int"}, {"n_to": "int"}).collect()] == [(2, 5)]
    run = tmp_path / "run7"
    run.mkdir()
    (run / "state.json").write_text(json.dumps({"log_history": [{"epoch": 1, "loss": 0.5}, {"epoch": 1, "eval_loss": 0.4}]}, indent=1))
    log = logs.read_training_log(spark, str(tmp_path))
    assert [(r.run, r.entry["loss"]) for r in logs.training_rows(log).collect()] == [("run7", 0.5)]
    assert [r.entry["eval_loss"] for r in logs.evaluation_rows(log).collect()] == [0.4]


def test_materialize_builds_once_per_parameters(spark, tmp_path):
    built = []

    def build(n):
        built.append(n)
        return spark.range(n)

    for n in (3, 3, 4):
        assert sinks.materialize(spark, "r", {"n": n}, lambda n=n: build(n), str(tmp_path)).count() == n
    assert built == [3, 4]
    assert sinks.result_key({"a": 1, "b": 2}) == sinks.result_key({"b": 2, "a": 1}) != sinks.result_key({"a": 1})


def test_zip_blobs_round_trip(spark):
    df = spark.createDataFrame([(f"p{i % 2}", f"{i}.txt", bytes([i])) for i in range(150)], "archive string, name string, content binary")
    blobs = archives.zip_batches(df.coalesce(1), "archive", "name", "content", members=20)
    assert blobs.count() == 8
    first = blobs.first()
    assert len(zipfile.ZipFile(io.BytesIO(first.content)).namelist()) <= 20
    assert archives.expand_archives(blobs).select("name").distinct().count() == 150


def test_rank_scores_of_billions_of_rows(spark):
    from samplemill.operators import metrics

    counts = spark.createDataFrame([(0.1, 0, 4 * 10**9), (0.5, 10**9, 10**9), (0.9, 4 * 10**9, 0)], "s double, _pos bigint, _neg bigint")
    got = metrics.ranking_of_counts(counts, "s").first()
    # Ties count one half: (4 * 5 + 1 * 4 + 1 * 0.5) / 25.
    assert got.roc == pytest.approx(0.98)


def test_missing_partners_end_the_job(spark):
    from samplemill.operators import filters, joins

    ids = spark.createDataFrame([("aa",), ("bb",)], "id string")
    features = spark.createDataFrame([("aa", 1)], "id string, v int")
    with pytest.raises(Exception, match="no features"):
        joins.with_features(ids, features, "id").collect()
    assert joins.with_features(ids, features, "id", check=False).count() == 1
    whole = joins.with_features(ids.where("id = 'aa'"), features, "id")
    assert whole.columns == ["id", "v"] and whole.collect()[0].v == 1
    archives = spark.createDataFrame([("x/a.zip",)], "archive string")
    with pytest.raises(Exception, match="no archive"):
        filters.attach_archive(ids, "id", archives, 1, check=True).collect()
    assert filters.attach_archive(ids, "id", archives, 1).count() == 1


def test_views_that_disagree_end_the_job(spark):
    from samplemill.operators import joins

    a = spark.createDataFrame([("x", "l", 1), ("y", "m", 2)], "name string, label string, v int")
    for rows in ([("x", "l", 3)], [("x", "l", 3), ("y", "other", 4)], [("x", "l", 3), ("y", "m", 4), ("z", "m", 5)]):
        b = spark.createDataFrame(rows, "name string, label string, w int")
        with pytest.raises(Exception, match="views disagree"):
            joins.merge_views({"a": a, "b": b}, "name", "label", check=True).collect()
    b = spark.createDataFrame([("x", "l", 3), ("y", "m", 4)], "name string, label string, w int")
    merged = [joins.merge_views({"a": a, "b": b}, "name", "label", check=c) for c in (True, False)]
    assert merged[0].columns == merged[1].columns and sorted(merged[0].collect()) == sorted(merged[1].collect())


def test_one_json_object_over_many_tasks(spark, tmp_path):
    """Strings with commas, quotes, brackets and escapes, nested values, and blocks that end anywhere."""
    rng = random.Random(6)
    odd = ["a,b", 'q"uo,te', "br{ac[ke]t}s,", "back\\slash,", '\\",\\\\"', "", ",", "é,\U0001F600", "{", "}]", "line\nfeed,", "\\"]
    whole = {f"id{i},{rng.choice(odd)}": [rng.choice(odd) for _ in range(rng.randrange(4))] for i in range(3000)}
    (tmp_path / "map.json").write_text(json.dumps(whole), encoding="utf-8")
    more = {"id0": ["x"], "empty": [], **{k: ["late,"] for k in list(whole)[:10]}}
    (tmp_path / "later.json").write_text(" " + json.dumps(more, indent=1) + "\n", encoding="utf-8")
    (tmp_path / "none.json").write_text(" { } ")
    paths = [str(tmp_path / f) for f in ("map.json", "later.json", "none.json")]
    spark.conf.set("spark.sql.files.maxPartitionBytes", 3000)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        assert spark.read.text(paths[0], lineSep=",").rdd.getNumPartitions() > 20
        got = {r.id: r.value for r in files.read_id_map(spark, paths, "array<string>", layout="object").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == whole | more


def test_object_maps_as_written(spark, tmp_path):
    rows = [(i, f'v "{i}", [' if i % 3 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, value string").repartition(5)
    path = str(tmp_path / "map")
    sinks.write_object_map(df, path, "id", "value")
    (text,) = [f.read_text() for f in (tmp_path / "map").iterdir() if f.name.startswith("part-")]
    assert json.loads(text) == {str(i): v for i, v in rows} and list(json.loads(text)) == [str(i) for i, _ in rows] and "\n" not in text
    got = {r.id: r.value for r in files.read_id_map(spark, [path], "string", layout="object").collect()}
    assert got == {str(i): v for i, v in rows}


def test_prefixes_get_writers_by_their_rows(spark, tmp_path):
    df = spark.createDataFrame([("aa" if i % 10 else "bb", i) for i in range(1000)], "id string, n int").selectExpr("concat(id, n) AS id", "n")
    # Small partitions would be put together again otherwise.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", 16)
    try:
        sinks.write_by_prefix(df, str(tmp_path / "out"), "id", 2, rows=100)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    parts = {p: len(list((tmp_path / "out" / f"prefix={p}").glob("part-*"))) for p in ("aa", "bb")}
    assert parts["bb"] == 1 and 3 <= parts["aa"] <= 9
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1000


def test_a_cluster_must_name_a_shared_folder(spark):
    from types import SimpleNamespace

    from samplemill.plans import session

    context = SimpleNamespace(master="spark://host:7077", _jvm=spark.sparkContext._jvm, _jsc=spark.sparkContext._jsc)
    values = {"spark.sql.warehouse.dir": "file:/somewhere/warehouse"}
    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: values.get(key, default)), sparkContext=context)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(fake)
    context.master = "local[4]"
    assert session.shared_dir(fake) == "file:/somewhere/warehouse/_samplemill"
    context.master, values[session.CHECKPOINT_KEY] = "spark://host:7077", "hdfs:///shared/"
    assert session.shared_dir(fake) == "hdfs:///shared"
