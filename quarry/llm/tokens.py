"""Problem 8: the ids of a public byte-level BPE, by recursive DuckDB queries in every partition."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = os.environ.get("QUARRY_TOKENIZERS", "/opt/tokenizers")
# Fixed value: how the byte-level vocabularies cut a text into words; white space is the Unicode property.
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+""")

#: One contraction a step: of every word, the leftmost pair of least rank. Words without a pair drop out; their last step is final.
CONTRACT = """
WITH RECURSIVE t(w, step, pos, id) AS (
  SELECT w, 0, pos, id FROM start
  UNION ALL
  SELECT w, step + 1, pos, if(key = best, joined, id) FROM (
    SELECT *, min(key) OVER (PARTITION BY w) AS best, lag(key) OVER (PARTITION BY w ORDER BY pos) AS before FROM (
      SELECT t.w, t.step, t.pos, t.id, m.joined, m.joined::BIGINT * 1000000 + t.pos AS key
      FROM (SELECT *, lead(id) OVER (PARTITION BY w ORDER BY pos) AS after FROM t) t
      LEFT JOIN merges m ON m.a = t.id AND m.b = t.after))
  WHERE best IS NOT NULL AND before IS DISTINCT FROM best AND step < {steps}
)
SELECT w, list(id ORDER BY pos) AS ids, max(step) AS step FROM (SELECT * FROM t QUALIFY step = max(step) OVER (PARTITION BY w)) GROUP BY w
"""

#: For long words: all places of the least-ranked pair at once, from the left, every second one where places overlap. A pair made by
#: a contraction has a greater rank, so this ends where one contraction at a time does.
CONTRACT_ALL = """
WITH RECURSIVE t(w, step, pos, id) AS (
  SELECT w, 0, pos, id FROM start
  UNION ALL
  SELECT w, step + 1, pos, if(take, joined, id) FROM (
    SELECT *, lag(take) OVER (PARTITION BY w ORDER BY pos) AS before FROM (
      SELECT *, hit AND (row_number() OVER (PARTITION BY w, hit, chain ORDER BY pos)) % 2 = 1 AS take FROM (
        SELECT *, row_number() OVER (PARTITION BY w ORDER BY pos) - row_number() OVER (PARTITION BY w, hit ORDER BY pos) AS chain FROM (
          SELECT *, best IS NOT NULL AND joined IS NOT DISTINCT FROM best AS hit FROM (
            SELECT *, min(joined) OVER (PARTITION BY w) AS best FROM (
              SELECT t.w, t.step, t.pos, t.id, m.joined
              FROM (SELECT *, lead(id) OVER (PARTITION BY w ORDER BY pos) AS after FROM t) t
              LEFT JOIN merges m ON m.a = t.id AND m.b = t.after))))))
  WHERE best IS NOT NULL AND before IS DISTINCT FROM TRUE AND step < {steps}
)
SELECT w, list(id ORDER BY pos) AS ids, max(step) AS step FROM (SELECT * FROM t QUALIFY step = max(step) OVER (PARTITION BY w)) GROUP BY w
"""
LONG = 256


class Encoder:
    """A worker's DuckDB with the merge table of one vocabulary, and the ids of words it has met."""

    def __init__(self, path: str, threads: int = 1, memory: str = "300MB", keep: int = 150_000):
        import duckdb

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.single = [self.ranks[bytes([i])] for i in range(256)]
        self.con = duckdb.connect(config={"threads": threads, "memory_limit": memory})
        self.con.register("m", pd.DataFrame(self._merges(), columns=["a", "b", "joined"], dtype="int64"))
        self.con.execute("CREATE TABLE merges AS SELECT a::INT AS a, b::INT AS b, joined::INT AS joined FROM m")
        self.words: dict[str, np.ndarray] = {}
        self.keep = keep

    def _merges(self) -> list[tuple[int, int, int]]:
        """Rows (a, b, joined) of the merge table: a token's rank is its id, and it joins the two parts left when only lower ranks merge."""
        rows = []
        for token, rank in self.ranks.items():
            if len(token) < 2:
                continue
            parts = [token[i : i + 1] for i in range(len(token))]
            while len(parts) > 2:
                at = min(range(len(parts) - 1), key=lambda i: r if (r := self.ranks.get(parts[i] + parts[i + 1], rank)) < rank else 1 << 40)
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            rows.append((self.ranks[parts[0]], self.ranks[parts[1]], rank))
        return rows

    def learn(self, words: list[str]) -> None:
        """Adds the ids of words; those of more than LONG characters by their own query, few at a time."""
        self._learn([w for w in words if len(w) <= LONG], 3000, 48, CONTRACT)
        self._learn([w for w in words if len(w) > LONG], 8, 12, CONTRACT_ALL)

    def _learn(self, words: list[str], batch: int, steps: int, query: str) -> None:
        """Adds the ids of words. A query makes at most steps contractions a word, so that long words don't pile up rows; the next one
        goes on where it stopped, until nothing changes."""
        at = 0
        while at < len(words):
            own, size = [], 0
            while at < len(words) and len(own) < batch and (not own or size + len(words[at]) <= 50_000):
                own.append(words[at])
                size += len(words[at])
                at += 1
            state = [np.array([self.single[x] for x in w.encode("utf-8", "surrogatepass")], np.int32) for w in own]
            open_ = [i for i, s in enumerate(state) if len(s) > 1]
            while open_:
                lengths = [len(state[i]) for i in open_]
                rows = pd.DataFrame({"w": np.repeat(np.array(open_, np.int32), lengths), "pos": np.concatenate([np.arange(n, dtype=np.int32) for n in lengths]), "id": np.concatenate([state[i] for i in open_])})
                self.con.register("start", rows)
                done = self.con.execute(query.format(steps=steps)).fetchall()
                open_ = []
                for w, ids, step in done:
                    state[w] = np.array(ids, np.int32)
                    if step == steps and len(ids) > 1:
                        open_.append(w)
            self.words.update(zip(own, state))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        cut = [PATTERN.findall(t) if t else [] for t in texts]
        if len(self.words) > self.keep:
            self.words.clear()
        new = sorted({w for ws in cut for w in ws if w not in self.words})
        self.learn(new)
        known = self.words
        return [np.concatenate([known[w] for w in ws]) if ws else np.zeros(0, np.int32) for ws in cut]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def token_ids(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(key, ids): the ids of each row's whole text without special tokens; strings of special tokens are ordinary text.

    Empty and null texts have an empty list of ids. Rows come out one for one, whatever their key. The vocabulary file is read where the executors run.
    """
    path = os.path.join(folder or TOKENIZERS, f"{vocabulary}.tiktoken")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoder(path)
        for b in batches:
            yield pd.DataFrame({"k": b.k, "ids": own.encode([t if isinstance(t, str) else None for t in b.t])})

    given = df.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"))
    return given.mapInPandas(work, "k string, ids array<int>").select(F.col("k").cast(df.schema[key].dataType).alias(key), "ids")


def decoded(df: DataFrame, key: str = "doc_id", vocabulary: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(key, text) of a frame of ids; the bytes of each list are joined in order by DuckDB. An empty list is an empty text."""
    path = os.path.join(folder or TOKENIZERS, f"{vocabulary}.tiktoken")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoder(path)
        if not hasattr(own, "bytes"):
            own.con.register("v", pd.DataFrame([(i, t.hex()) for t, i in own.ranks.items()], columns=["id", "hex"]))
            own.con.execute("CREATE TABLE pieces AS SELECT id::INT AS id, hex FROM v")
            own.bytes = True
        for b in batches:
            sizes = [len(x) for x in b.ids]
            rows = pd.DataFrame({"n": np.repeat(np.arange(len(b)), sizes), "pos": np.concatenate([np.arange(s) for s in sizes] or [[]]).astype(int), "id": np.concatenate(list(b.ids) or [[]]).astype(int)})
            own.con.register("ids", rows)
            joined = dict(own.con.execute("SELECT n, string_agg(hex, '' ORDER BY pos) FROM ids JOIN pieces USING (id) GROUP BY n").fetchall())
            yield pd.DataFrame({"k": b.k, "text": [bytes.fromhex(joined.get(i, "")).decode("utf-8", "replace") for i in range(len(b))]})

    given = df.select(F.col(key).cast("string").alias("k"), F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return given.mapInPandas(work, "k string, text string").select(F.col("k").cast(df.schema[key].dataType).alias(key), "text")
