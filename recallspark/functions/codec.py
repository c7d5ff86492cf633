"""Vectors as base64, hashes of texts, fingerprints and JSON from models."""

from __future__ import annotations

import base64
import json
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def encode_vector(vectors: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats as base64; null stays null."""
    return vectors.map(lambda v: None if v is None else base64.b64encode(np.asarray(v, "<f4").tobytes()).decode())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_vector(texts: pd.Series) -> pd.Series:
    """The inverse of ``encode_vector``; null for what isn't such a text."""

    def one(text):
        try:
            data = base64.b64decode(text, validate=True) if text else b""
        except ValueError:
            return None
        return np.frombuffer(data, "<f4") if data and len(data) % 4 == 0 else None

    return texts.map(one)


def hash53(texts: list[str | None], seed: int = 0) -> np.ndarray:
    """A 53-bit hash of each text's UTF-16 code units: two 32-bit lanes, multiplied and mixed. Null counts as empty.

    All texts are gone through side by side: a step takes the unit at one place of every text that is long enough. The last few long
    ones of a batch would make short steps, so texts are ordered by length and steps get shorter with them.
    """
    units = [np.frombuffer((t or "").encode("utf-16-le", "surrogatepass"), "<u2") for t in texts]
    lengths = np.array([len(u) for u in units], np.int64)
    order = np.argsort(-lengths, kind="stable")
    one = np.full(len(units), (0xDEADBEEF ^ seed) & 0xFFFFFFFF, np.uint32)
    two = np.full(len(units), (0x41C6CE57 ^ seed) & 0xFFFFFFFF, np.uint32)
    sorted_ = [units[i] for i in order]
    alive = len(sorted_)
    for lo in range(0, int(lengths.max(initial=0)), 4096):  # a block of places of all texts at a time bounds the memory
        while alive and len(sorted_[alive - 1]) <= lo:
            alive -= 1
        parts = [u[lo : lo + 4096] for u in sorted_[:alive]]
        block = np.zeros((len(parts[0]), alive), np.uint32)
        for i, part in enumerate(parts):
            block[: len(part), i] = part
        ends = np.array([len(part) for part in parts])
        n = alive
        for t in range(len(block)):
            while ends[n - 1] <= t:
                n -= 1
            one[:n] = (one[:n] ^ block[t, :n]) * np.uint32(2654435761)
            two[:n] = (two[:n] ^ block[t, :n]) * np.uint32(1597334677)
    first = ((one ^ (one >> 16)) * np.uint32(2246822507)) ^ ((two ^ (two >> 13)) * np.uint32(3266489909))
    second = ((two ^ (two >> 16)) * np.uint32(2246822507)) ^ ((first ^ (first >> 13)) * np.uint32(3266489909))
    out = np.empty(len(units), np.int64)
    out[order] = ((second & np.uint32(0x1FFFFF)).astype(np.int64) << 32) | first.astype(np.int64)
    return out


#: Texts that are hashed side by side.
SIDE = 512


@F.pandas_udf(T.LongType())
def text_hash(texts: pd.Series) -> pd.Series:
    # a few hundred at a time, so that the memory for their places doesn't grow with a batch
    parts = [hash53(texts.iloc[i : i + SIDE].tolist()) for i in range(0, len(texts), SIDE)]
    return pd.Series(np.concatenate(parts) if parts else np.empty(0, np.int64), index=texts.index)


def fingerprint(send_date: Column, name: Column, message: Column) -> Column:
    """A message's date, or a hash of its sender and text where it has none."""
    hashed = F.concat(F.lit("hash_"), text_hash(F.concat(F.coalesce(name, F.lit("")), F.coalesce(message, F.lit("")))).cast("string"))
    return F.coalesce(F.nullif(send_date, F.lit("")), hashed)


def json_blocks(text: str) -> list[str]:
    """Balanced {...} and [...] blocks of a text at its outer level; brackets in strings don't count."""
    found, depth, start, quoted, skip = [], 0, 0, False, False
    for i, c in enumerate(text):
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"' and depth:
            quoted = True
        elif c in "{[":
            start = i if not depth else start
            depth += 1
        elif c in "}]" and depth:
            depth -= 1
            if not depth:
                found.append(text[start : i + 1])
    return found


def repair_json(text: str | None) -> str | None:
    """Valid JSON out of a model's answer, or null: as it is, without fences, the last block, with small faults mended, and closed where cut off."""
    if not text:
        return None
    bare = re.sub(r"^\s*```\w*\s*|\s*```\s*$", "", text)
    tries = [text, bare, *reversed(json_blocks(bare))]
    mended = [re.sub(r",\s*([}\]])", r"\1", re.sub(r"(?<=[{,])\s*([A-Za-z_]\w*)\s*:", r' "\1":', t.replace("“", '"').replace("”", '"'))) for t in tries]
    start = min((i for i in (bare.find("{"), bare.find("[")) if i >= 0), default=-1)
    if start >= 0:
        open_, quoted = [], False
        for c in re.sub(r"\\.", "", bare[start:]):
            if c == '"':
                quoted = not quoted
            elif not quoted and c in "{[":
                open_.append("}" if c == "{" else "]")
            elif not quoted and c in "}]" and open_:
                open_.pop()
        mended.append(re.sub(r",\s*$", "", bare[start:] + '"' * quoted) + "".join(reversed(open_)))
    for candidate in [*tries, *mended]:
        try:
            value = json.loads(candidate)
        except ValueError:
            continue
        if isinstance(value, (dict, list)):
            return json.dumps(value, ensure_ascii=False)
    return None


def without_fields(value, fields: set[str]):
    """A JSON value without the given fields at any depth."""
    if isinstance(value, dict):
        return {k: without_fields(v, fields) for k, v in value.items() if k not in fields}
    return [without_fields(v, fields) for v in value] if isinstance(value, list) else value


@F.pandas_udf(T.StringType())
def strip_json(texts: pd.Series, fields: pd.Series) -> pd.Series:
    """JSON texts without the fields named; null for what isn't JSON."""

    def one(text, names):
        try:
            return json.dumps(without_fields(json.loads(text), set(names)), ensure_ascii=False) if text else None
        except ValueError:
            return None

    return pd.Series([one(t, f) for t, f in zip(texts, fields)], index=texts.index, dtype=object)


@F.pandas_udf(T.StringType())
def tolerant_json(texts: pd.Series) -> pd.Series:
    return texts.map(repair_json)


EVENTS = "array<struct<summary:string,importance:int,characters_involved:array<string>,witnesses:array<string>,location:string,is_secret:boolean,is_transient:boolean>>"


def parse_events(answer: Column) -> Column:
    """Events of an answer (an object with ``events`` or a bare array); those with a short summary or an importance out of 1..5 are dropped."""
    clean = tolerant_json(answer)
    events = F.coalesce(F.from_json(F.get_json_object(clean, "$.events"), EVENTS), F.from_json(clean, EVENTS))
    return F.filter(events, lambda e: (F.length(e["summary"]) >= 20) & F.coalesce(e["importance"], F.lit(3)).between(1, 5))
