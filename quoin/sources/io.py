"""Readers and writers: nested corpora, JSON lines, metrics, audits, digests."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import tempfile
import tomllib
import urllib.request
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .categories import LABELS

CORPUS = (
    "data array<struct<title: string, paragraphs: array<struct<context: string, qas: array<struct<question: string, "
    "answers: array<struct<text: string, answer_start: int>>>>>>>>"
)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to ``spark.checkpoint.dir`` (a temporary folder on one machine, where none is set) and read back:
    what names it several times neither plans nor works it out again, and a lost executor costs no more than this."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="quoin-")
    path = f"{base}/quoin/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Nested JSON documents, one a file."""
    return spark.read.schema(CORPUS).option("multiLine", True).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str, first: int | None = None, order: str | None = None) -> DataFrame:
    """JSON lines with a declared schema; the first ``first`` rows by ``order``."""
    rows = spark.read.schema(schema).json(path)
    return rows.orderBy(order).limit(first) if first is not None and order else rows


def write_jsonl(df: DataFrame, path: str) -> int:
    """JSON lines, nulls kept; returns the number of rows, counted while they are written."""
    from pyspark.sql import Observation

    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return seen.get["n"]


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """name, sha256 of files."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"))


def value_digest(df: DataFrame, label: str) -> DataFrame:
    """name, digest of a table's rows, whatever their order and files: the count and the sum of row hashes."""
    total = F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    return df.agg(F.concat_ws(":", F.count(F.lit(1)), total.cast("string")).alias("digest")).select(F.lit(label).alias("name"), "digest")


def mismatches(expected: DataFrame, built: DataFrame, digest: str = "digest") -> DataFrame:
    """Names whose built digest differs or is missing."""
    got = built.select("name", F.col(digest).alias("_got"))
    return expected.join(got, "name", "left").where(~F.col(digest).eqNullSafe(F.col("_got"))).select("name")


def read_metrics(spark: SparkSession, folder: str, runs: list[str]) -> dict | None:
    """Metrics of all runs, or None if any is missing or can't be read."""
    out = {}
    for run in runs:
        try:
            out[run] = json.loads("\n".join(r.value for r in spark.read.text(f"{folder}/{run}.json", wholetext=True).collect()))
        except Exception:  # noqa: BLE001
            return None
    return out


def audit_table(spark: SparkSession, path: str) -> DataFrame:
    """run, id, flag, verdict, note from a JSON map of runs; keys whose value isn't a map of verdicts are dropped."""
    text = spark.read.text(path, wholetext=True)
    whole = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("run", "body"))
    rows = whole.select("run", F.explode_outer(F.from_json("body", "map<string,struct<flag:string,verdict:string,note:string>>")).alias("id", "v"))
    return rows.where("id is not null").select("run", "id", "v.flag", "v.verdict", "v.note")


def write_json(value: object, path: str) -> None:
    """A small indented JSON file, written by the driver."""
    Path(path).write_text(json.dumps(value, indent=2, ensure_ascii=False) + "\n", encoding="utf-8")


def read_meta(spark: SparkSession, path: str) -> dict:
    """What a run says of itself (a small JSON object), empty if there is none."""
    try:
        rows = spark.read.text(path, wholetext=True).collect()
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return {}
        raise
    return json.loads("\n".join(r.value for r in rows))


def load_config(folder: str, name: str) -> dict:
    """A settings file by name, with or without its ending: JSON, TOML, or YAML where a reader for it is installed."""
    endings = (".json", ".toml", ".yaml", ".yml")
    names = [name] if name.endswith(endings) else [name + e for e in endings]
    for path in (Path(folder) / n for n in names):
        if path.exists():
            text = path.read_text(encoding="utf-8")
            if path.suffix == ".json":
                return json.loads(text)
            if path.suffix == ".toml":
                return tomllib.loads(text)
            import yaml

            return yaml.safe_load(text)
    raise FileNotFoundError(f"no settings {name} in {folder}")


def categories(spark: SparkSession, path: str | None = None) -> DataFrame:
    """pos, label, description in order of the list: of the JSON file ``path``, or the names packaged here."""
    told = json.loads(Path(path).read_text(encoding="utf-8")) if path else {"labels": LABELS}
    about = told.get("descriptions", {})
    return spark.createDataFrame([(i, x, about.get(x, "")) for i, x in enumerate(told["labels"])], "pos int, label string, description string")


def download(url: str, path: str, block: int = 1 << 20, timeout: float = 60) -> None:
    """Fetches a file block by block next to its place, and moves it there when it is whole."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_name(f"{target.name}.{uuid.uuid4().hex}.part")
    try:
        with urllib.request.urlopen(url, timeout=timeout) as source, part.open("wb") as out:
            shutil.copyfileobj(source, out, block)
        os.replace(part, target)
    finally:
        part.unlink(missing_ok=True)


def fetch_member(url: str, archive: str, member: str, target: str, sha256: str | None = None, force: bool = False) -> str:
    """The first file of a zip archive whose name ends in ``member``, at ``target``; what is there already is used. An
    archive with another digest is an error."""
    if force or not Path(archive).exists():
        download(url, archive)
    with open(archive, "rb") as f:
        got = hashlib.file_digest(f, "sha256").hexdigest()
    if sha256 and got != sha256:
        raise ValueError(f"{archive} has the digest {got} and not {sha256}")
    if force or not Path(target).exists():
        with zipfile.ZipFile(archive) as z:
            found = [n for n in z.namelist() if n.endswith(member)]
            if not found:
                raise ValueError(f"nothing in {archive} ends in {member}")
            with z.open(found[0]) as source, open(target, "wb") as out:
                shutil.copyfileobj(source, out)
    return target


def load_env(path: str, env: dict | None = None) -> dict:
    """KEY=VALUE lines; blanks and comments are skipped and what is set already wins."""
    env = os.environ if env is None else env
    if Path(path).exists():
        for line in Path(path).read_text(encoding="utf-8").splitlines():
            key, sep, value = line.strip().partition("=")
            if sep and not key.startswith("#"):
                env.setdefault(key.strip(), value.strip())
    return env


def render(template: str, values: dict[str, str]) -> str:
    """``$name`` filled in; an unfilled name is an error."""
    from string import Template

    return Template(template).substitute(values)
