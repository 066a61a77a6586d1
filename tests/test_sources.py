import hashlib
import json

from pyspark.sql import functions as F

from spanledger.operators.receipts import execution_receipt_violations
from spanledger.sources import captures, manifests, rules_xml, sinks, text
from spanledger.streaming.captures import ingest_available


def capture(entry, release, command="id", **over):
    row = {f: "x" for f in captures.FIELDS}
    row.update(entry_id=entry, rhel_version=release, command_as_run=command, pkg_versions={"a": "1"}, exit_code=0,
               undo_executed={"run": False, "reason": "r"}, command_hash_at_capture=hashlib.sha256(command.encode()).hexdigest())
    row.update(over)
    return {k: v for k, v in row.items() if v is not ...}


def put(folder, name, obj):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(obj if isinstance(obj, str) else json.dumps(obj))


def test_corpus_lines(spark, tmp_path):
    put(tmp_path, "a.txt", "one\n\nthree")
    put(tmp_path, "b.md", "no")
    got = sorted((r.line_no, r.line) for r in text.read_corpus_lines(spark, str(tmp_path)).collect())
    assert got == [(1, "one"), (2, ""), (3, "three")]


def test_jsonl(spark, tmp_path):
    put(tmp_path, "g.jsonl", '{"_meta":{"n":2}}\n{"c":"x","l":1}\n\n{"c":"y","l":5}\n')
    meta, rows = text.read_jsonl(spark, str(tmp_path), "n:int", "c string, l int")
    assert [r.n for r in meta.collect()] == [2]
    assert sorted((r.c, r.l) for r in rows.collect()) == [("x", 1), ("y", 5)]


def test_captures_report_each_defect(spark, tmp_path):
    put(tmp_path / "8", "good.json", capture("good", "8"))
    put(tmp_path / "8", "bad.json", "{nope")
    put(tmp_path / "8", "late.json", capture("late", "9"))
    put(tmp_path / "8", "named.json", capture("other", "8"))
    put(tmp_path / "8", "hash.json", capture("hash", "8", command_hash_at_capture="0"))
    put(tmp_path / "8", "less.json", capture("less", "8", kernel=...))
    put(tmp_path / "z" / "8", "good.json", capture("good", "8"))
    good, errors = captures.index_captures(captures.read_captures(spark, str(tmp_path)))
    assert [r.entry_id for r in good.collect()] == ["good"]
    assert sorted(r.code for r in errors.collect()) == [
        "duplicate-key", "entry-differs-from-name", "hash-mismatch", "missing-kernel", "not-json", "release-differs-from-path"]


def test_stream_ingest_equals_batch_and_keeps_first(spark, tmp_path):
    src, dest, check = tmp_path / "src", str(tmp_path / "dest"), str(tmp_path / "check")
    put(src / "8", "a.json", capture("a", "8"))
    ingest_available(spark, str(src), dest, check)
    put(src / "9", "b.json", capture("b", "9"))
    put(src / "again" / "8", "a.json", capture("a", "8", host="other"))
    ingest_available(spark, str(src), dest, check)
    ingest_available(spark, str(src), dest, check)
    got = sorted((r.entry_id, r.rhel_version, r.host) for r in spark.read.parquet(f"{dest}/captures").collect())
    assert got == [("a", "8", "x"), ("b", "9", "x")]
    assert [r.code for r in spark.read.parquet(f"{dest}/errors").collect()] == ["duplicate-key"]


def test_stream_equals_the_batch_index_and_never_rereads(spark, tmp_path):
    """Faults, keys repeated inside and across batches; what earlier batches wrote is damaged before the next run."""
    src, dest, check = tmp_path / "src", tmp_path / "dest", str(tmp_path / "check")
    put(src / "8", "a.json", capture("a", "8"))
    put(src / "b" / "8", "a.json", capture("a", "8", host="second"))
    put(src / "8", "bad.json", "{nope")
    put(src / "8", "less.json", capture("less", "8", kernel=..., host=...))
    ingest_available(spark, str(src), str(dest), check)
    kept = [(r.entry_id, r.host) for r in spark.read.parquet(f"{dest}/captures").collect()]
    codes = sorted(r.code for r in spark.read.parquet(f"{dest}/errors").collect())
    good, errors = captures.index_captures(captures.read_captures(spark, str(src)))
    assert kept == [(r.entry_id, r.host) for r in good.collect()] == [("a", "x")]
    assert codes == sorted(r.code for r in errors.collect()) == ["duplicate-key", "missing-host", "missing-kernel", "not-json"]
    for file in dest.rglob("*.parquet"):
        file.write_bytes(b"damaged")
        (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    for i in range(3):
        put(src / f"c{i}" / "8", "a.json", capture("a", "8", host=f"c{i}"))
    put(src / "9", "n.json", capture("n", "9"))
    ingest_available(spark, str(src), str(dest), check)
    late = max(int(p.name.split("=")[1]) for p in (dest / "captures").glob("batch=*"))
    assert [(r.entry_id, r.rhel_version) for r in spark.read.parquet(f"{dest}/captures/batch={late}").collect()] == [("n", "9")]
    assert [r.code for r in spark.read.parquet(f"{dest}/errors/batch={late}").collect()] == ["duplicate-key"] * 3


def test_rules_from_xml_files(spark, tmp_path):
    group = ('<Group id="V-{0}"><Rule id="R-{0}" severity="{1}"><version>{2}</version><title>t &amp;lt;b&amp;gt; {0}</title>'
             '<ident system="http://cci">CCI-2</ident><ident system="http://cci">CCI-1</ident><ident system="http://cci">CCI-2</ident>'
             '<check><check-content>c</check-content></check><fixtext>f</fixtext></Rule></Group>')
    put(tmp_path, "r.xml", "<B>" + group.format(1, "high", "S-1") + group.format(2, "low", "S-1") + group.format(3, "odd", "") + "</B>")
    rules = rules_xml.rule_rows(rules_xml.read_rules(spark, str(tmp_path)))
    first = rules.where("v = 'V-1'").first()
    assert (first.i, first.c, first.cci, first.t) == ("S-1", "I", ["CCI-2", "CCI-1"], "t <b> 1")
    got = sorted((r.v, r.code) for r in rules_xml.rule_violations(rules).collect())
    assert got == [("V-1", "duplicate-id"), ("V-3", "missing-id"), ("V-3", "unknown-severity")]


def test_residue_sink_is_stable(spark, tmp_path):
    rows = [("f", "8", i, "prose" if i % 2 else "odd", f"t{i}" + chr(0x200B)) for i in range(50)] + [("g", "9", 1, None, "kept")]
    judged = spark.createDataFrame(rows, "family string, release string, line_no int, reason string, text string")
    seen = []
    for name in ("one", "two"):
        sinks.write_residue(judged.repartition(3 if name == "one" else 5), ["line_no"], str(tmp_path / name))
        cell = tmp_path / name / "rows" / "family=f" / "release=8"
        seen.append(sorted(line for f in cell.glob("*.json") for line in f.read_text().splitlines()))
    assert seen[0] == seen[1] and len(seen[0]) == 50 and "\\\\u200B" in seen[0][0]
    counts = {(r.family, r.r): r.n for r in spark.read.json(str(tmp_path / "one" / "counts")).collect()}
    assert counts == {("f", "prose"): 25, ("f", "unparseable"): 25}


def test_pins_and_canonical_sink(spark, tmp_path):
    put(tmp_path / "in", "a.txt", "hello")
    found = manifests.file_digests(spark, str(tmp_path / "in"))
    row = found.first()
    assert (row.file, row.sha256, row.bytes) == ("a.txt", hashlib.sha256(b"hello").hexdigest(), 5)
    d = spark.createDataFrame([(2, "b"), (1, "a")], "n int, c string")
    sinks.write_canonical(d, ["n"], str(tmp_path / "out"))
    text_out = "".join(f.read_text() for f in sorted((tmp_path / "out").glob("part-*")))
    assert text_out == '{"c":"a","n":1}\n{"c":"b","n":2}\n'


def test_execution_receipts(spark):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    good = dict(entry_id="a", tool_version="1", target="t", operator="o", ticket="k", verification="v", rhel_version="8",
                executed_at="2026-09-17T10:00:00Z", exit_code=0, command="id", command_sha256=sha("id"), artifact_sha256=sha("x"),
                content_fingerprint=sha("y"), stdout="s", stdout_sha256=sha("s"), stderr="", stderr_sha256=sha(""),
                attestation=dict(command_was_executed=True, outputs_are_actual=True, statement="yes"))
    bad = [("b", dict(command="ls"), "digest-command"), ("c", dict(executed_at="2026-09-17T10:00:00"), "timestamp-zone"),
           ("d", dict(rhel_version="6"), "release"), ("e", dict(ticket=" "), "empty-ticket"), ("f", dict(exit_code=None), "exit-code"),
           ("g", dict(artifact_sha256="AB"), "digest-form-artifact_sha256"),
           ("h", dict(attestation=dict(command_was_executed=False, outputs_are_actual=True, statement="x")), "not-executed")]
    schema = ("entry_id string, tool_version string, target string, operator string, ticket string, verification string, "
              "rhel_version string, executed_at string, exit_code int, command string, command_sha256 string, artifact_sha256 string, "
              "content_fingerprint string, stdout string, stdout_sha256 string, stderr string, stderr_sha256 string, "
              "attestation struct<command_was_executed:boolean,outputs_are_actual:boolean,statement:string>")
    data = [good] + [{**good, "entry_id": e, **o} for e, o, _ in bad]
    got = sorted((r.entry_id, r.code) for r in execution_receipt_violations(spark.createDataFrame(data, schema)).collect())
    assert got == sorted((e, c) for e, _, c in bad)


def test_long_files_are_hashed_in_turns(spark, tmp_path):
    """The digest is that of the whole file, and no task reads much more than a part of it."""
    import hashlib
    import random
    from spanledger.sources import manifests
    rnd = random.Random(8)
    long = {"a b+c%41.bin": rnd.randbytes(13 << 20), "feed.bin": rnd.randbytes(9 << 20) + b"\n", "mark.bin": b"\xef\xbb\xbf\r\n" + rnd.randbytes(9 << 20) + b"x",
            "markfeed.bin": b"\xef\xbb\xbf" + b"\n" * (5 << 20), "packed.gz": rnd.randbytes(5 << 20)}
    every = long | {"small.bin": b"x\r\n"}
    for name, data in every.items():
        (tmp_path / name).write_bytes(data)
    got = {r.file: (r.sha256, r.bytes) for r in manifests.file_digests(spark, str(tmp_path), part=4 << 20).collect()}
    assert got == {n: (hashlib.sha256(d).hexdigest(), len(d)) for n, d in every.items()}
    assert manifests.file_digests(spark, str(tmp_path)).count() == len(every)


def test_a_turn_gives_each_task_one_file(spark, tmp_path, monkeypatch):
    """However many long files there are, a task hashes one of them at a time."""
    import hashlib
    import random
    from spanledger.sources import manifests
    rnd, advanced = random.Random(9), manifests._advanced

    def alone(states, marked):
        run = advanced(states, marked)

        def check(batches):
            out = list(run(batches))
            assert sum(b.num_rows for b in out) < 2
            yield from out
        return check

    monkeypatch.setattr(manifests, "_advanced", alone)
    every = {f"{i}.bin": rnd.randbytes(70_000 + i) for i in range(60)}
    for name, data in every.items():
        (tmp_path / name).write_bytes(data)
    got = {r.file: r.sha256 for r in manifests.file_digests(spark, str(tmp_path), part=1 << 16).collect()}
    assert got == {n: hashlib.sha256(d).hexdigest() for n, d in every.items()}


def test_tables_that_are_folders_are_cited_with_all_their_files(spark, tmp_path):
    """Files of two tables may share a name; short and long files alike are named by their path."""
    from spanledger.plans import catalog
    from spanledger.sources import manifests
    every = {"documents.parquet/part-0.parquet": b"a", "documents.parquet/part-1.parquet": b"b" * 200 + b"\n" + b"c" * 200,
             "pages.parquet/part-0.parquet": b"d", "labels.parquet/part-0.parquet": b"e", "orders.parquet": b"f", "part.parquet": b"g"}
    for name, data in every.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    found = manifests.file_digests(spark, str(tmp_path), "*.parquet", part=100)
    assert {r.file: r.sha256 for r in found.collect()} == {n: hashlib.sha256(d).hexdigest() for n, d in every.items()}
    got = {r.file for r in catalog.QUERIES["provenance_digests"](spark, f"file://{tmp_path}").collect()}
    assert got == {n for n in every if n.startswith(("documents", "pages", "orders"))}
