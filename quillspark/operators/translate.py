"""The model boundary: a translator is injected; batches of texts go through it, failures are rows and are retried in stages.

A model's calls are not repeatable, so what a stage has got from it is written once and read from there: stored() is given by the
caller's folder, or the checkpoint folder of the cluster."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import patterns as P
from quillspark.functions import text as T

# fixed values: messages of the connectors
CUT_OFF, EMPTY = "模型未完整返回内容，请检查输出长度限制或服务状态后重试", "模型返回空内容，请重试"
VISION_CUT_OFF, VISION_EMPTY, NO_IMAGE = "视觉模型输出被截断，请增大 max_tokens 后重试", "视觉模型返回空内容，请重试", "chat_with_images 需要至少一张图片"
PROBE, PROBE_SYSTEM = "Reply with exactly: OK", "You are a connection test assistant."


class Translator(Protocol):
    def translate(self, texts: Iterable[str]) -> list[str]:
        """One translation for each text; raises if the model fails or its reply is cut off."""


class StubTranslator:
    """Deterministic: a prefix before the text; texts that hold fails_on fail."""

    def __init__(self, prefix: str = "译:", fails_on: str | None = None):
        self.prefix, self.fails_on = prefix, fails_on

    def translate(self, texts):
        out = []
        for t in texts:
            if self.fails_on and self.fails_on in t:
                raise ValueError("model failed")
            out.append(self.prefix + t)
        return out


# ---- connectors


@dataclass
class Reply:
    text: str | None
    finish_reason: str | None = "stop"


class Model(Protocol):
    def complete(self, messages: list[dict], temperature: float, max_tokens: int) -> Reply:
        """One reply of a model's service."""


def _said(model_name: str, system: str, user: str | list) -> list[dict]:
    """Models that only translate get the system's words in the user's turn."""
    if model_name not in P.TRANSLATION_ONLY:
        return [{"role": "system", "content": system}, {"role": "user", "content": user}]
    if isinstance(user, str):
        return [{"role": "user", "content": f"{system}\n\n{user}" if system else user}]
    return [{"role": "user", "content": [{"type": "text", "text": f"{system}\n\n{user[0]['text']}"}, *user[1:]]}]


def chat(model: Model, name: str, prompt: str, system: str = "", max_tokens: int = 4096) -> str:
    """A text model's whole reply, at temperature 0; one that was cut off, or is empty, is an error."""
    reply = model.complete(_said(name, system, prompt), 0, max_tokens)
    if reply.finish_reason != "stop":
        raise ValueError(CUT_OFF)
    return _whole(reply, EMPTY)


def chat_with_images(model: Model, name: str, prompt: str, images: Sequence[str], system: str = "", max_tokens: int = 4096) -> str:
    """A vision model's reply to a prompt with images (data URLs). Services that don't say why they end are believed; ``length`` is an error."""
    if not images:
        raise ValueError(NO_IMAGE)
    content = [{"type": "text", "text": prompt}, *({"type": "image_url", "image_url": {"url": u}} for u in images)]
    reply = model.complete(_said(name, system, content), 0, max_tokens)
    if reply.finish_reason == "length":
        raise ValueError(VISION_CUT_OFF)
    return _whole(reply, VISION_EMPTY)


def _whole(reply: Reply, empty: str) -> str:
    text = (reply.text or "").strip()
    if not text:
        raise ValueError(empty)
    return text


def connection_test(model: Model, name: str) -> dict:
    """Whether a model answers, and what it says: a failure is an answer too."""
    try:
        return {"ok": True, "message": chat(model, name, PROBE, PROBE_SYSTEM)[:200]}
    except Exception as e:  # noqa: BLE001  any failure of the service is what is asked for
        return {"ok": False, "message": str(e)}


class ChatTranslator:
    """A translator that asks a text model for each text; model is made anew in each worker."""

    def __init__(self, make: Callable[[], Model], name: str, system: str = "", max_tokens: int = 4096):
        self.make, self.name, self.system, self.max_tokens = make, name, system, max_tokens

    def translate(self, texts):
        model = self.make()
        return [chat(model, self.name, t, self.system, self.max_tokens) for t in texts]


# ---- rows


def stored(rows: DataFrame, folder: str | None = None) -> DataFrame:
    """rows, written into a folder that all executors share, and read from there."""
    spark = rows.sparkSession
    folder = folder or spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        return rows.checkpoint() if spark.sparkContext.getCheckpointDir() else _in_memory(rows)
    path = f"{folder}/quillspark/model-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def _in_memory(rows: DataFrame) -> DataFrame:
    """Without a shared folder, on one machine: executors are threads of the driver and can't be lost."""
    kept = rows.cache()
    kept.count()
    return kept


def map_model(rows: DataFrame, translator: Translator, text: str = "text") -> DataFrame:
    """rows with translated and error; a batch that fails, or whose replies aren't one for each text, is tried once more text by text. Whatever
    the model raises is its row's error. Filter before: Spark can't push filters below."""
    names = rows.columns

    def asked(texts):
        found = list(translator.translate(texts))
        if len(found) != len(texts) or not all(isinstance(t, str) for t in found):
            raise ValueError("the model's replies don't match the texts")
        return found

    def failed(e):
        said = str(e) or type(e).__name__
        return f"{P.FAILED} {said}]", said

    def each(texts):
        try:
            return [(t, None) for t in asked(texts)]
        except Exception as e:  # noqa: BLE001  a service fails in many ways; none may end the job
            if len(texts) == 1:
                return [failed(e)]
        out = []
        for t in texts:
            try:
                out.append((asked([t])[0], None))
            except Exception as e:  # noqa: BLE001
                out.append(failed(e))
        return out

    def run(batches):
        for batch in batches:
            found = each([t or "" for t in batch.column(text).to_pylist()]) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string())], [*names, "translated", "error"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, translated string, error string")


def masked_translation(rows: DataFrame, translator: Translator, text: str = "text") -> DataFrame:
    """Atoms are masked before the model and put back after it; a reply that lost one, or that breaks fidelity, is an error."""
    masked = rows.withColumn("__m", T.mask(F.col(text))).select(*rows.columns, F.col("__m.masked").alias("__masked"), F.col("__m.atoms").alias("__atoms"))
    done = map_model(masked, translator, "__masked")
    back = T.unmask(F.col("translated"), F.col("__atoms"))
    done = done.withColumn("__back", F.when(F.col("error").isNull(), back))
    error = F.coalesce(F.col("error"), F.when(F.col("__back").isNull(), F.lit("模型遗漏或重复了公式、图注编号或科学符号")), T.hard_error(F.col(text), F.col("__back")))
    return done.withColumn("error", error).withColumn("translated", F.when(F.col("error").isNull(), F.col("__back")).otherwise(F.concat(F.lit(P.FAILED + " "), "error", F.lit("]")))).drop("__masked", "__atoms", "__back")


def staged_translation(rows: DataFrame, translator: Translator, retries: int = 2, text: str = "text", folder: str | None = None) -> DataFrame:
    """Masked attempts, each over the rows that failed before, then one unmasked; attempt says which gave the row. Each attempt's replies are
    stored, so a text reaches the model once for each attempt it takes (and once more if its batch failed)."""
    names = rows.columns
    out, left = None, rows
    for attempt in range(1, retries + 2):
        done = masked_translation(left, translator, text) if attempt <= retries else map_model(left, translator, text)
        done = stored(done.withColumn("attempt", F.lit(attempt)), folder)
        good = done if attempt > retries else done.where("error IS NULL")
        out = good if out is None else out.unionByName(good)
        left = done.where("error IS NOT NULL").select(*names)
        if left.isEmpty():
            break
    return out


def last_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of rows of the same keys (null is a key) the last."""
    last = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return rows.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")


def upsert(current: DataFrame, new: DataFrame, keys: list[str], columns: list[str], admits, order: list[str] | None = None) -> DataFrame:
    """current with columns of new where admits (over both, new's columns under new_*) says so; rows stay. Of several new rows of a key the last
    by order counts, or the greatest."""
    new = last_by(new, keys, [F.col(c) for c in order or columns])
    right = new.select(*[F.col(k).alias(f"__{k}") for k in keys], *[F.col(c).alias(f"new_{c}") for c in columns], F.lit(True).alias("__met"))
    on = F.lit(True)
    for k in keys:
        on = on & current[k].eqNullSafe(right[f"__{k}"])
    met = current.join(right, on, "left")
    take = F.coalesce(admits, F.lit(False)) & F.coalesce("__met", F.lit(False))
    return met.select(*[F.when(take, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in current.columns])
