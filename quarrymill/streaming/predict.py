"""The hook for models: any object with infer_batch, run where the rows are. Failures are rows, not exceptions."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "prompt string, invalid_json boolean, output string, raw_output string, error string, latency_seconds double, batch_latency_seconds double, batch_size int"


class Predictor(Protocol):
    """Made once a task; takes prompts and gives raw answers, one each."""

    def infer_batch(self, prompts: list[str]) -> list[str]: ...


class RulePredictor:
    """Labels prompts by length; blank ones get no valid answer."""

    def __init__(self, short: int):
        self.short = short

    def infer_batch(self, prompts: list[str]) -> list[str]:
        return [json.dumps({"label": "short" if len(p) < self.short else "long"}) if p.strip(" ") else "?" for p in prompts]


class KeepPredictor:
    """Calls all code clean and gives it back as it is: what an answer scores that changes nothing."""

    def infer_batch(self, prompts: list[str]) -> list[str]:
        texts = ("cwe", "vuln_type", "explanation", "patch_summary")
        return [
            json.dumps({"is_vulnerable": False, **dict.fromkeys(texts, "none"), "vulnerable_lines": [], "fixed_code": p.partition("Code:\n")[2], "safe_test": "assert True\n"})
            for p in prompts
        ]


def parse_answer(raw: str) -> tuple[str | None, str | None]:
    """A JSON object as text, or why there is none."""
    try:
        value = json.loads(raw)
    except ValueError as e:
        return None, str(e)
    return (json.dumps(value), None) if isinstance(value, dict) else (None, "not an object")


def predictions(records: DataFrame, predictor: Predictor, batch_size: int = 64) -> DataFrame:
    """records (id, prompt) with answers. A batch that fails is tried row by row; running out of memory ends the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, batch_size):
                part = whole.slice(k, batch_size)
                prompts = part.column("prompt").to_pylist()
                began = time.monotonic()
                try:
                    raw: list[tuple[str | None, str | None]] = [(x, None) for x in predictor.infer_batch(prompts)]
                except MemoryError:
                    raise
                except Exception:  # find the rows that fail
                    raw = []
                    for p in prompts:
                        try:
                            raw.append((predictor.infer_batch([p])[0], None))
                        except Exception as e:
                            raw.append((None, f"{type(e).__name__}: {e}"))
                took = time.monotonic() - began
                parsed = [parse_answer(r) if r is not None else (None, e) for r, e in raw]
                n = len(prompts)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"), pa.array(prompts, pa.string()), pa.array([o is None for o, _ in parsed], pa.bool_()), pa.array([o for o, _ in parsed], pa.string()),
                        pa.array([r for r, _ in raw], pa.string()), pa.array([e for _, e in parsed], pa.string()), pa.array([took / n] * n, pa.float64()), pa.array([took] * n, pa.float64()), pa.array([n] * n, pa.int32()),
                    ],
                    ["id", *[x.split()[0] for x in SCHEMA.split(", ")]],
                )

    kind = records.schema["id"].dataType.simpleString()
    return records.select("id", "prompt").mapInArrow(run, f"id {kind}, {SCHEMA}")
