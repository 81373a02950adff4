"""Problem 7: the main body of a web page, by a linear-chain conditional random field over the page's leaf blocks.

raw_text holds a page as lines, so a leaf block is a line; what its ancestors were shows in the indentation, list marker, table
bars and in the paragraph block around it. The field is trained on a bounded sample of labelled pages and decoded by Viterbi.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import repeated_lines
from quarry.llm.forms import fold
from quarry.session import stored

WORD = re.compile(r"[一-鿿]+|[^\W\d_一-鿿]+")
DIGITS = re.compile(r"\d+")
MARKER = re.compile(r"\s*(?:([-*•›>»—–|\[#])|\(([a-z0-9]{1,3})\)|\d{1,3}[A-Z]?\.\d+)")
TAG = re.compile(r"\s*</?([a-zA-Z][a-zA-Z0-9]*)")

def site_name(url: str | None) -> str:
    """What a site calls itself: the first part of its host, without hyphens."""
    host = re.sub(r"^[a-z]+://(?:www\.)?", "", (url or "").lower()).split("/")[0]
    return host.split(".")[0].replace("-", " ").casefold()


def features(text: str, site: str) -> tuple[list[int], list[list[str]]]:
    """The numbers (from 0) of a page's non-blank lines, and their features."""
    lines = text.split("\n")
    at = [i for i, x in enumerate(lines) if x.strip()]
    n, out = len(at), []
    blocks, block = [], -1
    for j, i in enumerate(at):
        if j == 0 or at[j - 1] != i - 1:
            block += 1
        blocks.append(block)
    size_of: dict[int, int] = {}
    for b in blocks:
        size_of[b] = size_of.get(b, 0) + 1
    for j, i in enumerate(at):
        raw = lines[i]
        line = fold(raw) or ""
        low = line.casefold()
        words = WORD.findall(low)
        flat: list[str] = []
        for w in words:
            if "一" <= w[0] <= "鿿":
                flat += [w[k : k + 2] for k in range(max(1, len(w) - 1))]
            else:
                flat.append(w)
        kind = MARKER.match(raw)
        f = ["b", f"len{min(12, int(2 * math.log2(len(line) + 1)) // 2)}", f"n{min(len(words), 12)}", f"end{line[-1:] if not line[-1:].isalnum() else 'w'}"]
        f.append("in" + (raw[:1] if raw[:1] in " \t" else "-"))
        f.append("mark" + ((kind[1] or ("(" if kind[2] else "rule")) if kind else "-"))
        f += [f"top{min(j, 14)}", f"bottom{min(n - 1 - j, 14)}", f"rel{10 * j // n}", f"block{min(size_of[blocks[j]], 8)}"]
        f.append(f"gap{int(j == 0 or blocks[j] != blocks[j - 1])}{int(j == n - 1 or blocks[j] != blocks[j + 1])}")
        if tag := TAG.match(raw):
            f.append("tag" + tag[1].lower())
        if "|" in line:
            f.append(f"bars{min(line.count('|'), 4)}")
        if DIGITS.search(line):
            f.append("digit")
        if line.isupper():
            f.append("upper")
        if site and site in low:
            f.append("site")
        if flat:
            f += ["first_" + flat[0], "last_" + flat[-1], "two_" + "_".join(flat[:2])]
            f += ["w_" + w for w in set(flat)]
        out.append(f)
    return at, out


class Field:
    """A two-state linear-chain field: 1 is boilerplate. Weights are of state 1 against state 0."""

    def __init__(self, weights: dict[str, float], edge: np.ndarray, start: np.ndarray):
        self.weights, self.edge, self.start = weights, edge, start

    @classmethod
    def train(cls, pages: list[tuple[list[list[str]], list[int]]], steps: int = 160, rate: float = 0.15, l2: float = 0.02, least: int = 2) -> Field:
        """Maximum likelihood by forward-backward and Adam, all pages side by side. Features in fewer than least lines don't count."""
        seen: dict[str, int] = {}
        for lines, _ in pages:
            for f in lines:
                for x in f:
                    seen[x] = seen.get(x, 0) + 1
        index = {x: i for i, x in enumerate(sorted(x for x, n in seen.items() if n >= least))}
        size, longest = len(pages), max((len(y) for _, y in pages), default=0)
        if not size or not longest:
            return cls({}, np.zeros((2, 2)), np.zeros(2))
        where, feats, gold, mask = [], [], np.zeros((size, longest), int), np.zeros((size, longest), bool)
        for p, (lines, y) in enumerate(pages):
            gold[p, : len(y)], mask[p, : len(y)] = y, True
            for t, f in enumerate(lines):
                own = [index[x] for x in f if x in index]
                feats += own
                where += [p * longest + t] * len(own)
        where, feats = np.array(where, np.int64), np.array(feats, np.int64)
        theta = np.zeros(len(index) + 6)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        last = mask.sum(1) - 1
        pairs = mask[:, 1:]
        seen_edges = np.array([[((gold[:, :-1] == a) & (gold[:, 1:] == b) & pairs).sum() for b in (0, 1)] for a in (0, 1)], float)
        seen_start = np.array([(gold[:, 0] == a).sum() for a in (0, 1)], float)
        rows = np.arange(size)
        for step in range(1, steps + 1):
            emit = np.zeros((size, longest, 2))
            emit[:, :, 1] = np.bincount(where, theta[feats], size * longest).reshape(size, longest)
            edge, start = theta[-6:-2].reshape(2, 2), theta[-2:]
            forward, backward = np.zeros_like(emit), np.zeros_like(emit)
            forward[:, 0] = start + emit[:, 0]
            for t in range(1, longest):
                forward[:, t] = np.logaddexp(forward[:, t - 1, 0, None] + edge[0], forward[:, t - 1, 1, None] + edge[1]) + emit[:, t]
            total = np.logaddexp(forward[rows, last, 0], forward[rows, last, 1])
            for t in range(longest - 2, -1, -1):
                later = backward[:, t + 1] + emit[:, t + 1]
                backward[:, t] = np.where(mask[:, t + 1, None], np.logaddexp(later[:, 0, None] + edge[:, 0], later[:, 1, None] + edge[:, 1]), 0)
            marginal = np.exp(forward + backward - total[:, None, None]) * mask[:, :, None]
            grad = np.zeros_like(theta)
            grad[:-6] = np.bincount(feats, (gold * mask - marginal[:, :, 1]).ravel()[where], len(index))
            joint = forward[:, :-1, :, None] + edge + (emit[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None]
            grad[-6:-2] = (seen_edges - (np.exp(np.minimum(joint, 0)) * pairs[:, :, None, None]).sum((0, 1))).ravel()
            grad[-2:] = seen_start - marginal[:, 0].sum(0)
            grad -= l2 * theta * 10
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            theta += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return cls({x: float(theta[i]) for x, i in index.items()}, theta[-6:-2].reshape(2, 2).copy(), theta[-2:].copy())

    def decode(self, lines: list[list[str]]) -> list[int]:
        """The most probable states, by Viterbi."""
        if not lines:
            return []
        get, ((e00, e01), (e10, e11)) = self.weights.get, self.edge.tolist()
        a, b = float(self.start[0]), float(self.start[1])
        back = []
        for t, f in enumerate(lines):
            own = sum([get(x, 0.0) for x in f])
            if t:
                p0, p1 = (0 if a + e00 >= b + e10 else 1), (0 if a + e01 >= b + e11 else 1)
                back.append((p0, p1))
                a, b = (b + e10 if p0 else a + e00), (b + e11 if p1 else a + e01)
            b += own
        state = int(b > a)
        out = [state]
        for p in reversed(back):
            state = p[state]
            out.append(state)
        return out[::-1]


def labels(raw: str, cleaned: str, own: set[str], at: list[int]) -> list[int]:
    """Labels for training: lines that cleaning dropped, and of the rest those that come back all over the site (own: their letters)."""
    kept = {re.sub(r"\s+", " ", x).strip() for x in cleaned.split("\n")}
    lines = raw.split("\n")
    return [int(re.sub(r"\s+", " ", lines[i]).strip() not in kept or "".join(x for x in lines[i].lower() if x.isalpha()) in own) for i in at]


#: Lines of a stretch of a page that trains as one chain.
STRETCH = 400


def train(docs: DataFrame, pages: int = 700) -> Field:
    """A field trained on at most pages web pages (a documented, bounded sample, taken by a hash of the id); pages of more than STRETCH
    lines train in stretches.

    What comes back all over a site is counted over all documents, by the operator of repeated lines; only the sampled pages' own
    such lines come to the driver.
    """
    web = docs.where("document_id is not null and metadata.source_url is not null and raw_text <> '' and cleaned_text <> ''")
    web = web.select("document_id", "source_path", "metadata.source_url", "raw_text", "cleaned_text")
    slots = web.select("document_id", F.xxhash64("document_id").alias("h")).groupBy(F.pmod("h", F.lit(pages)).alias("slot")).agg(F.min(F.struct("h", "document_id")).alias("m")).select(F.col("m.document_id").alias("document_id"))
    sample = stored(web.join(F.broadcast(slots), "document_id").dropDuplicates(["document_id"]))  # at most pages rows
    shown = repeated_lines.web_documents(docs)
    often = repeated_lines.frequent_lines(repeated_lines.lines_of(shown), repeated_lines.thresholds(shown, 5, 0.2)).select("site", "key")
    own = repeated_lines.lettered(sample.select(repeated_lines.site_of().alias("site"), "document_id", "cleaned_text"))
    own = own.withColumn("key", F.xxhash64("letters")).join(often, ["site", "key"], "left_semi").groupBy("document_id").agg(F.collect_set("letters").alias("own"))
    given = []
    for r in sample.join(own, "document_id", "left").orderBy("document_id").collect():
        at, f = features(r.raw_text, site_name(r.source_url))
        y = labels(r.raw_text, r.cleaned_text, set(r.own or ()), at)
        given += [(f[i : i + STRETCH], y[i : i + STRETCH]) for i in range(0, len(at), STRETCH)]
    return Field.train(given)


def boilerplate(docs: DataFrame, field: Field) -> DataFrame:
    """(document_id, line_no): non-blank lines of web pages that aren't the notice's own. Rows of one id count once; null, empty and
    blank texts have no lines."""
    weights = docs.sparkSession.sparkContext.broadcast(field)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = weights.value
        for b in batches:
            ids, numbers = [], []
            for k, url, raw in zip(b.document_id, b.source_url, b.raw_text):
                at, f = features(raw, site_name(url))
                hit = [i + 1 for i, s in zip(at, own.decode(f)) if s]
                ids += [k] * len(hit)
                numbers += hit
            yield pd.DataFrame({"document_id": pd.Series(ids, dtype=object), "line_no": pd.Series(numbers, dtype="int64")})

    web = docs.where("document_id is not null and metadata.source_url is not null and raw_text <> ''").select("document_id", F.col("metadata.source_url").alias("source_url"), "raw_text")
    return web.mapInPandas(judge, "document_id string, line_no bigint").distinct()


def main_content(docs: DataFrame, field: Field) -> DataFrame:
    """(document_id, main_text): each web page once, without the lines boilerplate() finds. A page of none but such comes out empty."""
    weights = docs.sparkSession.sparkContext.broadcast(field)

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = weights.value
        for b in batches:
            texts = []
            for url, raw in zip(b.source_url, b.raw_text):
                at, f = features(raw, site_name(url))
                gone, lines = {i for i, s in zip(at, own.decode(f)) if s}, raw.split("\n")
                texts.append("\n".join(x for i, x in enumerate(lines) if i not in gone).strip("\n"))
            yield pd.DataFrame({"document_id": b.document_id, "main_text": texts})

    web = docs.where("document_id is not null and metadata.source_url is not null and raw_text is not null").select("document_id", F.col("metadata.source_url").alias("source_url"), "raw_text").dropDuplicates(["document_id"])
    return web.mapInPandas(keep, "document_id string, main_text string")
