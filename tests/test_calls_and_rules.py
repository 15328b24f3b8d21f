"""The call stage against a served endpoint that fails now and then; rules as rows against the built-in ones."""

from __future__ import annotations

import json
import threading
from collections import Counter
from datetime import date
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.error import HTTPError
from urllib.request import Request, urlopen

import pytest
from pyspark.sql import functions as F

from grantlake.functions.constants import EXCLUSIVE_PROGRAMS, PROGRAM_SEQUENCES
from grantlake.operators import calls, eligibility
from grantlake.sources.keyed import KeyedStore


class Endpoint(BaseHTTPRequestHandler):
    """Answers with the payloads in capitals; every third request is told to wait, ``down`` fails all requests with a payload from it."""

    seen, answered, sizes, down, lock, requests = Counter(), Counter(), [], set(), threading.Lock(), 0

    def do_POST(self):
        batch = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        with self.lock:
            cls = type(self)
            cls.requests += 1
            cls.sizes.append(len(batch))
            cls.seen.update(batch)
            status = 500 if cls.down & set(batch) else 429 if cls.requests % 3 == 0 else 200
            if status == 200:
                cls.answered.update(batch)
        body = json.dumps([p.upper() for p in batch]).encode()
        self.send_response(status)
        self.end_headers()
        if status == 200:
            self.wfile.write(body)

    def log_message(self, *_):
        pass


@pytest.fixture
def endpoint():
    Endpoint.seen, Endpoint.answered, Endpoint.sizes, Endpoint.down, Endpoint.requests = Counter(), Counter(), [], set(), 0
    server = ThreadingHTTPServer(("127.0.0.1", 0), Endpoint)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/"
    server.shutdown()


def client(url: str):
    def service(batch: list[str]) -> list[str | None]:
        from grantlake.operators.calls import Busy

        try:
            with urlopen(Request(url, json.dumps(batch).encode()), timeout=10) as got:
                return json.loads(got.read())
        except HTTPError as failed:
            if failed.code == 429:
                raise Busy(0.01) from failed
            raise

    return service


def test_each_payload_is_answered_once(spark, tmp_path, endpoint):
    texts = [f"text {k % 70}" for k in range(150)] + [None, " ", "", "bad"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("answer_of", F.lit("x"))
    ledger = KeyedStore(spark, f"{tmp_path}/ledger", "payload_hash")
    Endpoint.down = {"bad"}
    how = {"batch": 4, "tries": 3, "first_wait": 0.01, "wave": 40, "task": 10}
    first = {r.id: r.answer for r in calls.answered(rows, "text", client(endpoint), ledger, **how).collect()}
    # The batches with the bad payload have no answer, all others do.
    lost = {k for k, t in enumerate(texts) if (t or "").strip() and first[k] is None}
    assert 153 in lost
    assert len({texts[k] for k in lost}) <= 4 * how["batch"]
    assert all(first[k] == texts[k].upper() for k in range(150) if k not in lost)
    assert first[150] is first[151] is first[152] is None
    assert max(Endpoint.sizes) <= 4
    assert set(Endpoint.answered.values()) == {1}
    before = Endpoint.answered.copy()
    Endpoint.down = set()
    second = {r.id: r.answer for r in calls.answered(rows, "text", client(endpoint), ledger, **how).collect()}
    assert all(second[k] == t.upper() for k, t in enumerate(texts) if (t or "").strip())
    assert set(Endpoint.answered.values()) == {1}
    assert set(Endpoint.answered - before) == {texts[k] for k in lost}
    n = Endpoint.requests
    assert calls.answered(rows, "text", client(endpoint), ledger, **how).filter("answer IS NOT NULL").count() == 151
    assert Endpoint.requests == n
    assert calls.answered(rows.limit(0), "text", client(endpoint), ledger, **how).count() == 0


def test_waits_double_with_jitter():
    assert list(calls.waits(5, 1.0, 5.0, lambda: 1.0)) == [1.0, 2.0, 4.0, 5.0]
    assert list(calls.waits(3, 1.0, 5.0, lambda: 0.0)) == [0.5, 1.0]
    slept, told = [], iter([calls.Busy(9.0), OSError("down"), ["a"], ["a", "b"]])

    def service(batch):
        answer = next(told)
        if isinstance(answer, Exception):
            raise answer
        return answer

    assert calls.called(service, ["x", "y"], tries=4, first=1.0, sleep=slept.append) == ["a", "b"]
    assert slept[0] == 9.0
    assert 1.0 <= slept[1] <= 2.0
    assert 2.0 <= slept[2] <= 4.0
    assert calls.called(lambda b: [], ["x"], tries=2, first=0.0, sleep=slept.append) == [None]


def people(spark):
    programs = [*EXCLUSIVE_PROGRAMS, *[p for pair in PROGRAM_SEQUENCES for p in pair], "other", None]
    histories = [None, [], *[[p] for p in programs[:-1]], EXCLUSIVE_PROGRAMS, ["a", None]]
    rows = [(p, a, c) for p in programs for a in histories for c in histories]
    return spark.createDataFrame(rows, "program string, active array<string>, completed array<string>")


@pytest.mark.parametrize("most", [eligibility.MOST_RULES, 0])
def test_rows_of_rules_equal_the_built_in_ones(spark, most):
    rules = spark.createDataFrame(eligibility.program_rules(), eligibility.RULES)
    who = people(spark).withColumn("wanted", eligibility.rule_reasons(F.col("program"), F.col("active"), F.col("completed")))
    found = eligibility.with_rule_reasons(who, rules, F.col("program"), F.col("active"), F.col("completed"), most)
    assert found.count() == people(spark).count()
    assert found.filter(~F.col("wanted").eqNullSafe(F.col("rule_reasons"))).count() == 0


def test_a_rule_is_added_as_a_row(spark):
    rows = [*eligibility.program_rules(), (9, "sequence", "other", ["first", "second"]), (8, "exclusive", "other", ["other", "rival"]), (7, "unknown", "other", ["x"]), (1, "sequence", None, ["x"])]
    rules = spark.createDataFrame(rows, eligibility.RULES)
    pairs = spark.createDataFrame([(1, ["rival"], ["first"]), (2, [], ["first", "second"]), (3, None, None)], "id long, active array<string>, completed array<string>")
    record = pairs.select(
        "id", F.lit(None).cast("double").alias("age_min"), F.lit(None).cast("double").alias("age_max"), F.lit(True).alias("is_nationwide"), F.array().cast("array<string>").alias("region_codes"),
        F.struct(F.lit("none").alias("kind"), F.lit(None).cast("double").alias("max_ratio"), F.lit(None).cast("double").alias("max_amount")).alias("income"),
        F.struct(F.lit("always").alias("kind"), F.lit(None).cast("date").alias("start"), F.lit(None).cast("date").alias("end")).alias("recruit"), F.lit("other").alias("program_key"),
        F.struct(F.lit(20.0).alias("age"), F.lit("11").alias("region_code"), F.lit(1.0).alias("median_ratio"), F.lit(1.0).alias("amount"), F.col("active").alias("active_programs"), F.col("completed").alias("completed_programs")).alias("profile"),
    )
    got = {r.id: (r.reasons, r.bucket) for r in eligibility.evaluate(record, date(2026, 6, 24), rules=rules).collect()}
    assert got[1][0] == ["DUPLICATE_EXCLUSIVE", "PREREQ_NOT_MET"]
    assert got[2] == ([], "now")
    assert got[3][0] == ["PREREQ_UNKNOWN", "PREREQ_UNKNOWN"]
    assert "rule_reasons" not in eligibility.evaluate(record, date(2026, 6, 24), rules=rules).columns
