"""Calls of the world outside that are made once: answers are kept by their prompt, before anything uses them.

A task that fails is run again from its beginning, and a job may be started anew; what was asked before must not be asked
(and paid for) twice. An answer is a file of its own in a folder that all executors share, named by the hash of its
prompt, written under another name first and then moved. Errors aren't kept.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Client = Callable[[str], str]


class Ledger:
    """Answers in a folder: a path or an address that ``pyarrow.fs`` knows."""

    def __init__(self, folder: str):
        self.folder = folder

    def _place(self, prompt: str):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.folder) if "://" in self.folder else (fs.LocalFileSystem(), self.folder)
        key = hashlib.sha256(prompt.encode()).hexdigest()
        return system, f"{root.rstrip('/')}/{key[:2]}", key

    def get(self, prompt: str) -> str | None:
        system, folder, key = self._place(prompt)
        try:
            with system.open_input_stream(f"{folder}/{key}") as f:
                return f.read().decode()
        except FileNotFoundError:
            return None

    def put(self, prompt: str, answer: str) -> None:
        system, folder, key = self._place(prompt)
        system.create_dir(folder, recursive=True)
        part = f"{folder}/.{key}-{uuid.uuid4().hex}"
        with system.open_output_stream(part) as f:
            f.write(answer.encode())
        system.move(part, f"{folder}/{key}")


def kept(client: Client, folder: str | None) -> Client:
    """``client``, asked only what the ledger in ``folder`` doesn't know; without a folder the client itself."""
    if folder is None:
        return client
    ledger = Ledger(folder)

    def ask(prompt: str) -> str:
        known = ledger.get(prompt)
        if known is None:
            known = client(prompt)
            ledger.put(prompt, known)
        return known

    return ask


def asked(requests: DataFrame, client: Client, folder: str | None = None, at_once: int = 8, prompt_col: str = "prompt", answer_col: str = "answer") -> DataFrame:
    """``requests`` with the client's answers: equal prompts are asked once, ``at_once`` calls run at a time at most.

    A null prompt has a null answer, and so has one that the client can't answer (any error).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = kept(client, folder)
        for batch in batches:
            for key, prompt in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    said = ask(prompt)
                except Exception:  # a client may raise whatever its library does
                    said = None
                yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([said], pa.string())], names=["_key", answer_col])

    key = F.sha2(prompt_col, 256)
    prompts = requests.where(F.col(prompt_col).isNotNull()).select(key.alias("_key"), prompt_col).dropDuplicates(["_key"])
    said = prompts.repartition(at_once, "_key").mapInArrow(run, f"_key string, {answer_col} string")
    return requests.withColumn("_key", key).join(said, "_key", "left").drop("_key")
