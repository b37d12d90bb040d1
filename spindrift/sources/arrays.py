"""Step arrays in NPZ files and episode logs in MCAP files, read from any store Spark reads."""

from __future__ import annotations

import io
import json
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STEPS = "episode_id string, step int, t double, features array<double>, chunk array<array<double>>, state array<double>, truth string"
TOPIC = "/episode"
MAGIC = b"\x89MCAP0\r\n"


def _steps(content: bytes, name: str, duration: float | None):
    with np.load(io.BytesIO(content), allow_pickle=False) as z:
        a = {k: z[k] for k in z.files}
    n = next((len(a[k]) for k in ("actions", "features", "state") if k in a), 0)
    t = a["timestamps"] if "timestamps" in a else np.linspace(0.0, duration if duration is not None else max(n - 1, 0), n)
    actions = a.get("actions")
    if actions is not None and actions.ndim == 2:
        actions = actions[:, None, :]
    truth = str(a["truth"].item()) if "truth" in a else None
    row = lambda k, i: a[k][i].astype(float).tolist() if k in a else None
    return [(name, i, float(t[i]), row("features", i), actions[i].astype(float).tolist() if actions is not None else None, row("state", i), truth) for i in range(n)]


def read_npz(spark: SparkSession, path: str, duration: float | None = None) -> DataFrame:
    """A row per step of each file; times that are not recorded run evenly to `duration` (or to the last step's number)."""

    def run(batches):
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = _steps(content, p.rsplit("/", 1)[-1].removesuffix(".npz"), duration)
                if rows:
                    yield pd.DataFrame(rows, columns=[c.split()[0] for c in STEPS.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInPandas(run, STEPS)


def npz_bytes(**arrays) -> bytes:
    out = io.BytesIO()
    np.savez_compressed(out, **arrays)
    return out.getvalue()


def mcap_bytes(records: list[tuple[int, str]]) -> bytes:
    """(log time in ns, JSON) messages on the episode topic, as an unchunked MCAP file."""
    text = lambda s: struct.pack("<I", len(s.encode())) + s.encode()
    record = lambda op, body: struct.pack("<BQ", op, len(body)) + body
    out = [MAGIC, record(1, text("") + text("spindrift")), record(3, struct.pack("<H", 1) + text("episode") + text("jsonschema") + struct.pack("<I", 2) + b"{}"), record(4, struct.pack("<HH", 0, 1) + text(TOPIC) + text("json") + struct.pack("<I", 0))]
    out += [record(5, struct.pack("<HIQQ", 0, k, at, at) + body.encode()) for k, (at, body) in enumerate(records)]
    return b"".join([*out, record(15, struct.pack("<I", 0)), record(2, struct.pack("<QQI", 0, 0, 0)), MAGIC])


def mcap_messages(content: bytes, topic: str = TOPIC):
    """(log time, data) of a topic's messages; chunks may be plain or Zstandard."""
    if not content.startswith(MAGIC):
        raise ValueError("not an MCAP file")
    channels: set[int] = set()

    def walk(data, at):
        while at + 9 <= len(data):
            op, n = struct.unpack_from("<BQ", data, at)
            body = data[at + 9 : at + 9 + n]
            at += 9 + n
            if op == 4:
                channel, _, size = struct.unpack_from("<HHI", body)
                if body[8 : 8 + size].decode() == topic:
                    channels.add(channel)
            elif op == 5:
                channel, _, log_time, _ = struct.unpack_from("<HIQQ", body)
                if channel in channels:
                    yield log_time, bytes(body[22:])
            elif op == 6:
                size = struct.unpack_from("<I", body, 28)[0]
                kind = body[32 : 32 + size].decode()
                records = body[32 + size + 8 :]
                if kind == "zstd":
                    import zstandard

                    records = zstandard.ZstdDecompressor().decompressobj().decompress(records)
                elif kind:
                    raise ValueError(f"chunks packed by {kind} cannot be read")
                yield from walk(records, 0)
            elif op in (2, 15):
                return

    yield from walk(content, len(MAGIC))


def read_mcap(spark: SparkSession, path: str) -> DataFrame:
    """(log_time, value) of every episode message of the files."""

    def run(batches):
        for pdf in batches:
            for content in pdf["content"]:
                rows = [(t, d.decode()) for t, d in mcap_messages(bytes(content))]
                if rows:
                    yield pd.DataFrame(rows, columns=["log_time", "value"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.mcap").option("recursiveFileLookup", True).load(path)
    return files.select("content").mapInPandas(run, "log_time long, value string")


def episodes_from_mcap(spark: SparkSession, path: str) -> DataFrame:
    from spindrift.sources.tables import EPISODE

    return read_mcap(spark, path).select(F.from_json("value", EPISODE).alias("e")).select("e.*")


def verify_hash(document: dict, field: str) -> bool:
    """Whether a document's own hash field is the hash of its other fields."""
    from spindrift.functions.hashing import content_hash

    return document.get(field) == content_hash({k: v for k, v in document.items() if k != field})


def battery_lines(name: str, scenarios: list[dict]) -> list[str]:
    """A battery as JSON lines: a header with the hash of all scenarios, then a line each with its own hash."""
    from spindrift.functions.hashing import content_hash

    rows = [{"index": k, "params": p, "hash": content_hash(p)} for k, p in enumerate(scenarios)]
    return [json.dumps({"kind": "battery", "name": name, "n": len(rows), "battery_hash": content_hash([r["hash"] for r in rows])}), *map(json.dumps, rows)]


def read_battery(spark: SparkSession, path: str) -> DataFrame:
    """(index, params, scenario_hash) of a battery; a scenario or header whose hash does not fit raises."""
    from spindrift.functions.hashing import content_hash

    lines = spark.read.text(path).select("value", F.get_json_object("value", "$.kind").alias("kind"))
    head = json.loads(lines.where("kind = 'battery'").first().value)

    def check(batches):
        for pdf in batches:
            rows = [json.loads(v) for v in pdf["value"]]
            bad = [r["index"] for r in rows if content_hash(r["params"]) != r["hash"]]
            if bad:
                raise ValueError(f"scenarios {bad} were changed")
            yield pd.DataFrame([(r["index"], {k: float(v) for k, v in r["params"].items()}, r["hash"]) for r in rows], columns=["index", "params", "scenario_hash"])

    rows = lines.where("kind is null").mapInPandas(check, "index int, params map<string,double>, scenario_hash string")
    hashes = [r.scenario_hash for r in rows.orderBy("index").select("scenario_hash").collect()]  # a battery is a few thousand scenarios
    if len(hashes) != head["n"] or content_hash(hashes) != head["battery_hash"]:
        raise ValueError("the battery does not match its header")
    return rows
