"""Lexical and vector retrieval, fusion and evidence: an index is plain DataFrames, a batch of queries is a table."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import text as T
from quarry.session import stored

K1, B = 1.5, 0.75
#: Units that a search looks up together; twice as many and more are searched in groups.
TOGETHER = 4096


@dataclass
class LexicalIndex:
    """postings(part, term, gaps, tf, ids, lengths), terms(term, df, idf), corpus(n, avgdl).

    Texts are indexed in parts where they lie: a row holds a term's places in the part, as gaps, and its counts there. A part's first row
    also holds the part's ids and numbers of tokens.
    """

    postings: DataFrame
    terms: DataFrame
    corpus: DataFrame
    texts: DataFrame | None = None  # of an index that isn't written yet: (n), from which with its postings corpus is made

    def encoded(self, words: list[str]) -> tuple:
        """Texts that hold some of words as _encoded, the row of corpus, and how many texts hold each word, by its place in words."""
        asked = F.broadcast(self.postings.sparkSession.createDataFrame(list(enumerate(words)), "place int, term string"))  # a stated set of queries
        own = self.postings.join(asked, "term", "left").where("place is not null or ids is not null")
        kind = self.postings.schema["ids"].dataType.elementType.simpleString()

        def work(table):
            import numpy as np
            import pyarrow as pa

            t = table.combine_chunks()
            head = t.filter(t["ids"].is_valid())
            ids, length = head["ids"].combine_chunks().flatten(), head["lengths"].combine_chunks().flatten()
            t = t.filter(t["place"].is_valid())
            gaps, tf, place = t["gaps"].combine_chunks(), t["tf"].combine_chunks().flatten().to_numpy(), t["place"].to_numpy().astype(np.int64)
            many, doc = np.diff(gaps.offsets.to_numpy()), np.cumsum(gaps.flatten().to_numpy().astype(np.int64))
            first = np.cumsum(many) - many
            doc -= np.repeat(np.where(first > 0, doc[first - 1], 0), many) if len(doc) else 0
            place = np.repeat(place, many)
            turn = np.lexsort((place, doc))
            held, first = np.unique(doc[turn], return_index=True)
            starts, held = pa.array(np.append(first, len(turn)).astype(np.int32)), pa.array(held)
            of = lambda x: pa.ListArray.from_arrays(starts, pa.array(x[turn].astype(np.int32)))
            return pa.table({"chunk_id": ids.take(held), "length": length.take(held), "terms": of(place), "counts": of(tf)})

        docs = own.groupBy("part").applyInArrow(work, f"chunk_id {kind}, length int, terms array<int>, counts array<int>")
        df = {r.place: r.df for r in self.terms.join(asked, "term").select("place", "df").collect()}
        return docs, self.corpus.first(), df


def index_corpus(postings: DataFrame, texts: DataFrame) -> DataFrame:
    """(n, avgdl) of an index's postings and its number of texts (n)."""
    total = postings.where("ids is not null").agg(F.coalesce(F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x)), F.lit(0)).alias("total"))
    return texts.crossJoin(F.broadcast(total)).select("n", F.try_divide("total", "n").alias("avgdl"))  # one row each


def index_terms(postings: DataFrame, corpus: DataFrame) -> DataFrame:
    """(term, df, idf) of an index's postings."""
    df = postings.groupBy("term").agg(F.sum(F.size("gaps")).alias("df")).crossJoin(F.broadcast(corpus))  # one row
    return df.select("term", "df", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))


def lexical_index(chunks: DataFrame, key: str = "chunk_id", text: str = "text", part: int = 65536) -> LexicalIndex:
    """Chunks of one id count once; chunks without tokens count in n and avgdl but have no postings; null texts are empty.
    Neither texts nor postings are shuffled, but for texts of repeated ids."""
    docs = _once(chunks.select(F.col(key).alias("chunk_id"), F.coalesce(F.lower(text), F.lit("")).alias("text")))
    cut = _cutter(chunks.sparkSession, False)

    def work(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0

        def block(held):
            """One part's rows in order of terms; none without tokens."""
            ids = pa.concat_arrays([x[0] for x in held])
            every = pa.concat_arrays([x[1] for x in held]).dictionary_encode()
            terms, code = every.dictionary, every.indices.to_numpy().astype(np.int64)
            order = pc.sort_indices(terms)
            rank = np.empty(len(terms), np.int64)
            rank[order.to_numpy()] = np.arange(len(terms))
            at, row, lengths, cells = 0, 0, [], []
            for own, values, rows, codes in held:
                cells.append(rank[code[at : at + len(values)][codes]] * len(ids) + rows + row)
                lengths.append(np.bincount(rows, minlength=len(own)))
                at, row = at + len(values), row + len(own)
            cell, tf = np.unique(np.concatenate(cells), return_counts=True)
            if not len(cell):
                return None
            term, doc = np.divmod(cell, len(ids))
            there, first = np.unique(term, return_index=True)
            gaps = np.diff(doc, prepend=0)
            gaps[first] = doc[first]
            starts = pa.array(np.append(first, len(cell)).astype(np.int32))
            of = lambda x: pa.ListArray.from_arrays(starts, pa.array(x.astype(np.int32)))
            lead = lambda x: pa.concat_arrays([y := pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x), pa.nulls(len(there) - 1, y.type)])
            n, lengths = pa.array(np.full(len(there), (task << 32) + number)), pa.array(np.concatenate(lengths).astype(np.int32))
            return pa.RecordBatch.from_arrays([n, terms.take(order).take(pa.array(there)), of(gaps), of(tf), lead(ids), lead(lengths)], ["part", "term", "gaps", "tf", "ids", "lengths"])

        held, count, size = [], 0, 0
        for b in batches:
            for own, values, rows, codes in cut(b):
                held.append((own, values, rows, codes))
                count, size = count + len(own), size + len(codes)
                if count >= part or size >= 200 * part:
                    if out := block(held):
                        yield out
                    held, count, size, number = [], 0, 0, number + 1
        if held and (out := block(held)):
            yield out

    kind = docs.schema["chunk_id"].dataType.simpleString()
    postings = docs.mapInArrow(work, f"part bigint, term string, gaps array<int>, tf array<int>, ids array<{kind}>, lengths array<int>")
    n = chunks.select(key).distinct().agg(F.count("*").alias("n"))
    corpus = index_corpus(postings, n)
    return LexicalIndex(postings, index_terms(postings, corpus), corpus, n)


def _asked(queries: DataFrame, tokens: Column, most_mb: int = 256) -> list[tuple]:
    """(query_id, tokens) of a stated query set, collected; more than most_mb of them is an error: search in parts."""
    asked = queries.select("query_id", tokens.alias("tokens")).where("size(tokens) > 0")
    size = asked.agg(F.sum(F.length(F.array_join("tokens", " ")) + 16 * F.size("tokens") + 64)).first()[0] or 0
    if size > most_mb << 20:
        raise ValueError(f"queries of {size >> 20} MB: search in parts of {most_mb} MB")
    return [(r.query_id, r.tokens) for r in asked.collect()]  # bound by most_mb


def repeated(chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(again): hashes of the ids that come again, stored, so that searches of the same chunks share it. Only hashes are shuffled; an id
    that merely shares its hash is looked at as well."""
    return stored(chunks.groupBy(F.xxhash64(key).alias("again")).count().where("count > 1").select("again"))


def _once(rows: DataFrame, most: int = 500_000, again: DataFrame | None = None, work: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """What work makes of rows, one of each chunk_id. Whole rows are shuffled only of ids that come again (repeated); with more than most
    ids of that kind, which are broadcast, what work makes of all rows is shuffled instead."""
    again = repeated(rows) if again is None else again
    if again.count() > most:
        return work(rows).dropDuplicates(["chunk_id"])
    same = F.xxhash64("chunk_id") == F.col("again")
    return work(rows.join(F.broadcast(again), same, "left_anti").unionByName(rows.join(F.broadcast(again), same, "left_semi").dropDuplicates(["chunk_id"])))


def _cutter(spark, mixed: bool):
    """A function of Arrow batches (id, text) of lower-cased texts without nulls: yields (ids, values, rows, codes) for stretches of a batch,
    the tokens being values[codes] at rows. The tokens are those of T.bm25_tokens or, mixed, of T.mixed_tokens with repeats: whole
    batches are cut by arithmetic on their code points. What letters and digits are is asked of the JVM, as its expressions have it.
    """
    import numpy as np

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    known = np.zeros(0x110000, bool)
    known[[ord(c) for c in spark.sparkContext._jvm.java.util.regex.Pattern.compile(r"[^\p{L}\p{N}]").matcher(every).replaceAll("")]] = True
    shared = spark.sparkContext.broadcast(np.packbits(known))
    stop_words, stop_chars = list(T.STOP_WORDS), [ord(c) for c in T.STOP_CHARS]

    def cut(batch, most=2 << 20):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if mixed:
            inside_of = np.ones(0x110000, bool)
            inside_of[[9, 10, 11, 12, 13, 32]] = False
        else:
            inside_of = np.unpackbits(shared.value).astype(bool)
        stop = np.zeros(0x110000, bool)
        stop[stop_chars] = True
        ids, texts = batch.column(0), batch.column(1).cast(pa.large_string())
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        every = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        low = 0
        while low < len(texts):
            high = max(low + 1, int(np.searchsorted(ends, ends[low] + most, side="right")) - 1)
            data, offsets = every[ends[low] : ends[high]], ends[low : high + 1] - ends[low]
            points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
            at = np.flatnonzero((data & 0xC0) != 0x80)  # where each code point begins
            width = np.diff(at, append=len(data))
            row_at = np.searchsorted(at, offsets)
            edge = np.zeros(len(points) + 1, bool)
            edge[row_at] = True
            inside = inside_of[points]
            start = inside & (edge[:-1] | ~np.append(False, inside[:-1]))
            first = np.flatnonzero(start)
            sizes = np.add.reduceat(width * inside, first) if len(first) else np.empty(0, np.int64)
            row_of = lambda x: np.searchsorted(row_at, x, side="right") - 1
            chinese = (points >= 0x4E00) & (points <= 0x9FFF)
            c = np.flatnonzero(chinese)
            row = row_of(c)
            met = row[1:] == row[:-1]
            if mixed:
                met &= ~(stop[points[c[1:]]] | stop[points[c[:-1]]])
            else:
                met &= c[1:] == c[:-1] + 1
            three = np.arange(3)
            pairs = data[np.hstack([at[c[:-1][met]][:, None] + three, at[c[1:][met]][:, None] + three])] if len(c) > 1 else np.empty((0, 6), np.uint8)
            rows = np.concatenate([row_of(first), row[:-1][met]])
            where = np.concatenate([[0], np.cumsum(np.concatenate([sizes, np.full(len(pairs), 6)]))])
            letters = np.concatenate([data[np.repeat(inside, width)], pairs.ravel()])
            tokens = pa.Array.from_buffers(pa.string(), len(rows), [None, pa.py_buffer(where.astype(np.int32)), pa.py_buffer(letters)]).dictionary_encode()
            values, codes = tokens.dictionary, tokens.indices.to_numpy()
            if mixed:
                good = pc.and_(pc.greater(pc.utf8_length(values), 1), pc.invert(pc.is_in(values, pa.array(stop_words, pa.string())))).to_numpy(zero_copy_only=False)
                rows, codes = rows[good[codes]], codes[good[codes]]
            del points, at, width, edge, inside, start, first, sizes, chinese, c, row, pairs, where, letters, tokens  # while the rows are worked on
            yield ids.slice(low, high - low), values, rows, codes
            low = high

    return cut


def _encoded(chunks: DataFrame, words: list[str], mixed: bool, key: str = "chunk_id", text: str = "text", again: DataFrame | None = None) -> DataFrame:
    """(chunk_id, length, terms, counts) of each id once: a text's number of tokens (mixed: of different ones), and its tokens among words
    by their places there, with counts. Texts are never shuffled, but for those of repeated ids if they are few: each is tokenised where it
    is read and leaves only these numbers."""
    docs = chunks.select(F.col(key).alias("chunk_id"), F.coalesce(F.lower(text), F.lit("")).alias("text"))
    shared, cut = chunks.sparkSession.sparkContext.broadcast(words), _cutter(chunks.sparkSession, mixed)

    def work(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        asked = pa.array(shared.value, pa.string())
        width = max(len(asked), 1)
        for b in batches:
            for ids, values, row, code in cut(b):
                if mixed:
                    row, code = np.divmod(np.unique(row * len(values) + code), max(len(values), 1))
                length = np.bincount(row, minlength=len(ids))
                place = pc.fill_null(pc.index_in(values, value_set=asked), -1).to_numpy()[code]
                cell, count = np.unique((row * width + place)[place >= 0], return_counts=True)
                starts = pa.array(np.searchsorted(cell, np.arange(len(length) + 1) * width).astype(np.int32))
                of = lambda x: pa.ListArray.from_arrays(starts, pa.array(x.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(length.astype(np.int32)), of(cell % width), of(count)], ["chunk_id", "length", "terms", "counts"])

    kind = docs.schema["chunk_id"].dataType.simpleString()
    return _once(docs, again=again, work=lambda x: x.mapInArrow(work, f"chunk_id {kind}, length int, terms array<int>, counts array<int>"))


def _best(docs: DataFrame, units: list[list[tuple[int, float]]], k: int, avgdl: float | None = None, sizes: list[int] | None = None) -> DataFrame:
    """(unit, chunk_id, score): of every part of docs (_encoded, ids once) at least all that can be among a unit's best k.

    A unit is a list of (term, weight). With avgdl the score is the sum of weights by BM25's share of the term, else the Jaccard similarity
    of sets, sizes being the units' own. A unit's terms are taken by their greatest possible share; once those left can't lift a text over
    the k-th best score that the task has seen, only the texts met so far are looked up in the rest, so that common words cost little. Bounds
    are kept above every true score: nothing is left out.

    Every task passes on up to k texts of each unit. Both the units and the parts of a table grow with the input, so parts are searched
    together, in four tasks a core: what is shuffled grows with the units alone. Many units are cut into groups that share these tasks:
    each group reads all of docs (stored then) in as many tasks less, so that a unit meets few tasks and its bounds are soon known.
    """
    tasks = 4 * docs.sparkSession.sparkContext.defaultParallelism
    groups = min(len(units) // TOGETHER, tasks)
    if groups > 1:
        at = [len(units) * i // groups for i in range(groups + 1)]
        own = [(a, _group(docs, units[a:b], k, avgdl, sizes and sizes[a:b], max(tasks // groups, 1))) for a, b in zip(at, at[1:])]
        return reduce(DataFrame.unionByName, [x.withColumn("unit", F.col("unit") + F.lit(a)) for a, x in own])
    return _group(docs, units, k, avgdl, sizes, tasks)


def _group(docs: DataFrame, units: list[list[tuple[int, float]]], k: int, avgdl: float | None, sizes: list[int] | None, tasks: int) -> DataFrame:
    """_best of units that are looked up together, in at most so many tasks."""
    import numpy as np

    docs = docs.coalesce(tasks)
    starts = np.cumsum([0] + [len(u) for u in units])
    shared = docs.sparkSession.sparkContext.broadcast((starts, np.array([t for u in units for t, _ in u], np.int64), np.array([w for u in units for _, w in u], np.float64), np.array(sizes or [0] * len(units), np.float64)))
    k1, b0 = K1, B

    def work(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        starts, all_terms, all_weights, own = shared.value
        n_units = len(starts) - 1
        unit_of = np.repeat(np.arange(n_units), np.diff(starts))
        top = [np.empty(0)] * n_units
        least = np.full(n_units, -np.inf)  # a unit's k-th best score so far

        def search(parts):
            """Rows of units, places and scores over one block of texts, in order of their ids."""
            ids = pa.concat_arrays([p.column(0) for p in parts])
            order = pc.sort_indices(ids, null_placement="at_start")
            ids, order = ids.take(order), order.to_numpy()
            n = len(order)
            place = np.empty(n, np.int64)
            place[order] = np.arange(n)
            length = np.concatenate([p.column(1).to_numpy() for p in parts])[order].astype(np.float64)
            many = np.concatenate([np.diff(p.column(2).offsets.to_numpy()) for p in parts])
            flat = lambda c: np.concatenate([p.column(c).flatten().to_numpy() for p in parts])
            terms, docs = flat(2), np.repeat(place, many)
            turn = np.argsort(terms * np.int64(n) + docs)
            terms = terms[turn]
            docs = docs[turn]
            if avgdl is not None:
                tf = flat(3)[turn].astype(np.float64)
                share = tf * (k1 + 1) / (tf + k1 * (1 - b0 + b0 * length[docs] / avgdl))
                del tf
            del turn
            first = np.flatnonzero(np.diff(terms, prepend=-1))
            there = terms[first].astype(np.int64)
            last = np.append(first[1:], len(terms))
            most = np.maximum.reduceat(share, first) if avgdl is not None and len(first) else np.ones(len(first))
            kind = np.float64 if avgdl is not None else np.float32  # numbers of terms are whole: exact in either
            wide = [i for i in np.argsort(first - last, kind="stable")[:64] if 20 * (last[i] - first[i]) > n]
            columns = {}  # common terms as whole columns, at most 34 MB: added and looked up without their places
            for i in wide:
                x = slice(first[i], last[i])
                columns[i] = np.zeros(n, kind)
                columns[i][docs[x]] = share[x] if avgdl is not None else 1.0
            place = np.minimum(np.searchsorted(there, all_terms), max(len(there) - 1, 0))
            held = np.flatnonzero(there[place] == all_terms) if len(there) else np.empty(0, np.int64)
            all_j, all_w, of = place[held], all_weights[held], unit_of[held]
            all_bound = all_w * most[all_j]
            by = np.lexsort((last[all_j] - first[all_j], -all_bound, of))
            all_j, all_w, all_bound = all_j[by], all_w[by], all_bound[by]
            begin = np.searchsorted(of, np.arange(n_units + 1))
            sums, part, out = np.empty(n, kind), np.empty(n, kind), []
            for u in range(n_units):
                j, w, bound = (x[begin[u] : begin[u + 1]] for x in (all_j, all_w, all_bound))
                if not len(j):
                    continue
                rest = np.append(np.cumsum(bound[::-1])[::-1], 0.0)  # what terms from here on can add at most
                low = least[u] - 2e-6
                reach = rest >= low if avgdl is not None else rest >= low * own[u]
                must = int(reach[:-1].sum()) if low > 0 else len(j)
                if not must:
                    continue
                if must == 1:
                    x = slice(first[j[0]], last[j[0]])
                    cand, s = docs[x], w[0] * share[x] if avgdl is not None else np.ones(x.stop - x.start)
                else:
                    sums.fill(0.0)
                    for i in range(must):
                        x = slice(first[j[i]], last[j[i]])
                        if (c := columns.get(j[i])) is None:
                            sums[docs[x]] += w[i] * share[x] if avgdl is not None else 1.0
                        else:
                            sums += np.multiply(c, w[i], out=part) if avgdl is not None else c
                    over = (low if avgdl is not None else low * own[u]) - rest[must] if low > 0 else 0.0
                    cand = np.flatnonzero(sums >= over if over > 0 else sums > 0)
                    s = sums[cand].astype(np.float64)
                for i in range(must, len(j) + 1):
                    if low > 0:
                        can = s + rest[i] >= low if avgdl is not None else (s + rest[i]) * (1 + low) >= low * (own[u] + length[cand])
                        cand, s = cand[can], s[can]
                    if i == len(j) or not len(cand):
                        break
                    if (c := columns.get(j[i])) is not None:
                        s = s + w[i] * c[cand]
                        continue
                    x = docs[first[j[i]] : last[j[i]]]
                    at = np.minimum(np.searchsorted(x, cand), len(x) - 1)
                    s = s + (x[at] == cand) * (w[i] * share[first[j[i]] + at] if avgdl is not None else 1.0)
                if avgdl is not None:
                    s = np.floor(s * 1e6 + 0.5) / 1e6
                else:
                    union = own[u] + length[cand] - s
                    s = np.floor((2e6 * s + union) / (2 * union)) / 1e6  # whole numbers: halves go up exactly
                keep = (s > 0) & (s >= least[u])
                cand, s = cand[keep], s[keep]
                if len(s) > k:
                    cut = np.partition(s, -k)[-k]
                    over = s > cut
                    over[np.nonzero(s == cut)[0][: k - over.sum()]] = True  # ties by id
                    cand, s = cand[over], s[over]
                if len(s):
                    top[u] = np.sort(np.concatenate([top[u], s]))[-k:]
                    if len(top[u]) == k:
                        least[u] = top[u][0]
                    out.append((np.full(len(s), u, np.int32), cand, s))
            u, c, s = (np.concatenate([o[i] for o in out]) if out else np.empty(0, kind) for i, kind in ((0, np.int32), (1, np.int64), (2, np.float64)))
            return pa.RecordBatch.from_arrays([pa.array(u), ids.take(pa.array(c)), pa.array(s)], ["unit", "chunk_id", "score"])

        held, count, size = [], 0, 4096  # a small block first, that bounds are known early
        for b in batches:
            at = 0
            while at < len(b):
                take = min(len(b) - at, size - count)
                held.append(b.slice(at, take))
                at, count = at + take, count + take
                if count == size:
                    yield search(held)
                    held, count, size = [], 0, 65536
        if held:
            yield search(held)

    kind = docs.schema["chunk_id"].dataType.simpleString()
    return docs.mapInArrow(work, f"unit int, chunk_id {kind}, score double")


def _by_query(found: DataFrame, queries: DataFrame, owners: list[tuple], k: int) -> DataFrame:
    """A unit's best to each query (query_id, unit) that asks it."""
    kind = queries.schema["query_id"].dataType.simpleString()
    if not owners:
        return ranked(found.select(F.lit(None).cast(kind).alias("query_id"), "chunk_id", "score").where("false"), k)
    own = queries.sparkSession.createDataFrame(owners, f"query_id {kind}, unit int")
    best = ranked(found.withColumnRenamed("unit", "query_id"), k).withColumnRenamed("query_id", "unit").drop("rank")
    return ranked(best.join(F.broadcast(own), "unit").select("query_id", "chunk_id", "score"), k)


def bm25(queries: DataFrame, chunks: DataFrame | LexicalIndex, k: int = 20, key: str = "chunk_id", text: str = "text", again: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank): positive scores only, best k of each query, ties by chunk_id; scores rounded to 6 places.

    chunks is a table of texts, or an index that was stored before: only its postings of the queries' terms are read then. Of texts only
    terms of the queries are indexed: each text is tokenised once, and what is left of it, its length and its counts of the asked terms,
    is kept as a table that lengths, document frequencies and scores read. Repeated query tokens add. queries are a stated set, whose
    terms are broadcast, its size checked; queries of the same terms are scored once. again is repeated(chunks), where it is there already.
    """
    bags: dict = {}
    for q, tokens in _asked(queries, T.bm25_tokens("text")):
        bags.setdefault(q, Counter()).update(tokens)
    words = sorted({t for c in bags.values() for t in c})
    places = {t: i for i, t in enumerate(words)}
    if isinstance(chunks, LexicalIndex):
        docs, corpus, df = chunks.encoded(words)
    else:
        docs = stored(_encoded(chunks, words, False, key, text, again))
        corpus = docs.agg(F.count("*").alias("n"), F.avg("length").alias("avgdl")).first()
        df = {r.term: r.df for r in docs.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()}  # one row a word
    idf = {t: math.log((corpus.n - n + 0.5) / (n + 0.5) + 1) for t, n in df.items()}
    units: dict = {}
    owners = []
    for q, c in bags.items():
        bag = tuple(sorted((places[t], n * idf[places[t]]) for t, n in c.items() if places[t] in idf))
        owners.append((q, units.setdefault(bag, len(units))))
    if isinstance(chunks, LexicalIndex) and len(units) >= 2 * TOGETHER:
        docs = stored(docs)  # read by every group
    return _by_query(_best(docs, list(units), k, avgdl=corpus.avgdl or 1.0), queries, owners, k)


def overlap(queries: DataFrame, chunks: DataFrame, k: int = 20, again: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank) by the Jaccard similarity of mixed token sets; pairs without a shared token don't meet.

    queries are a stated set as in bm25, and searched in the same way.
    """
    asked = _asked(queries, T.mixed_tokens("text"))
    places = {t: i for i, t in enumerate(sorted({t for _, tokens in asked for t in tokens}))}
    docs = _encoded(chunks, list(places), True, again=again).where("size(terms) > 0")
    units: dict = {}
    owners = [(q, units.setdefault(tuple(sorted((places[t], 1.0) for t in tokens)), len(units))) for q, tokens in asked]
    docs = stored(docs) if len(units) >= 2 * TOGETHER else docs  # read by every group
    return _by_query(_best(docs, list(units), k, sizes=[len(u) for u in units]), queries, owners, k)


def ranked(scored: DataFrame, k: int | None = None) -> DataFrame:
    """rank within a query by score, ties by chunk_id; a limit per query is pushed below the shuffle by Spark."""
    out = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")))
    return out.where(F.col("rank") <= k) if k else out


def normalized(vector: Column | str) -> Column:
    """Unit length; a zero vector stays as it is."""
    v = F.col(vector) if isinstance(vector, str) else vector
    v = v.cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _matrix(queries: DataFrame, most_mb: int = 256):
    """Ids and unit vectors of a stated query set, to be broadcast; more than most_mb of them is an error: search in parts."""
    import numpy as np

    size = queries.agg(F.sum(F.size("embedding") * 8 + 64)).first()[0] or 0
    if size > most_mb << 20:
        raise ValueError(f"queries of {size >> 20} MB: search in parts of {most_mb} MB, or take approximate neighbours")
    rows = queries.select("query_id", normalized("embedding").alias("embedding")).orderBy("query_id").collect()  # bound by most_mb
    return [r.query_id for r in rows], np.array([r.embedding for r in rows], np.float64).reshape(len(rows), -1)


def dense(queries: DataFrame, vectors: DataFrame, k: int = 20, block: int = 256, least: float | None = None, drop_self: bool = False) -> DataFrame:
    """(query_id, chunk_id, score, rank): exact top k by inner product of unit vectors.

    queries (query_id, embedding) are a stated set, whose matrix is broadcast, its size checked; the corpus stays where it is. Each
    Arrow batch meets the queries in blocks, and leaves only its own best k of each query to the shuffle.
    """
    import numpy as np
    import pandas as pd

    kind, other = queries.schema["query_id"].dataType.simpleString(), vectors.schema["chunk_id"].dataType.simpleString()
    shared = vectors.sparkSession.sparkContext.broadcast(_matrix(queries))

    def work(batches):
        ids, matrix = shared.value
        for b in batches:
            own, c = b.chunk_id.to_numpy(), np.stack(b.embedding.to_list()).astype(np.float64)
            for at in range(0, len(ids), block):
                scores = np.round(matrix[at : at + block] @ c.T, 6)
                if least is not None:
                    scores[scores < least] = -np.inf
                if drop_self:
                    scores[np.array(ids[at : at + block], dtype=object)[:, None] == own[None, :]] = -np.inf
                cut = np.partition(scores, -min(k, scores.shape[1]), axis=1)[:, -min(k, scores.shape[1])]
                q, j = np.nonzero((scores >= cut[:, None]) & (scores > -np.inf))
                yield pd.DataFrame({"query_id": [ids[at + i] for i in q], "chunk_id": own[j], "score": scores[q, j]})

    unit = vectors.select("chunk_id", normalized("embedding").alias("embedding"))
    return ranked(unit.mapInPandas(work, f"query_id {kind}, chunk_id {other}, score double"), k)


def centroids(vectors: DataFrame, count: int, sample: int = 20_000, rounds: int = 8):
    """Unit centroids of a sample of at most sample vectors by a hash of the id (a documented, bounded sample), by spherical k-means."""
    import numpy as np

    rows = vectors.select(normalized("embedding").alias("embedding"), F.xxhash64("chunk_id").alias("h")).orderBy("h").limit(sample).collect()
    x = np.array([r.embedding for r in rows], np.float64)
    if not len(x):
        return np.zeros((0, 1))
    c = x[np.linspace(0, len(x) - 1, min(count, len(x))).astype(int)]
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 0, total / np.maximum(norm, 1e-12), c)
    return c


def approximate_neighbours(vectors: DataFrame, k: int = 5, lists: int = 64, probes: int = 16, block: int = 2000, least: float | None = None, sample: int = 20_000) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k nearest other vectors of every vector, within its nearest lists.

    An inverted file: centroids are fitted on a bounded sample, every vector is put into its nearest list and looks into its probes nearest
    ones. Lists are cut into blocks by a hash of the id, so a list that holds a third of all vectors is spread over tasks; a task meets a
    list's block with those who look there. Scores are exact, what is approximate is which pairs meet.
    """
    import numpy as np
    import pandas as pd

    kind = vectors.schema["chunk_id"].dataType.simpleString()
    unit = vectors.dropDuplicates(["chunk_id"]).select("chunk_id", normalized("embedding").alias("embedding"))
    shared = vectors.sparkSession.sparkContext.broadcast(centroids(vectors, lists, sample))

    def assign(batches):
        c = shared.value
        for b in batches:
            near = np.argsort(-(np.stack(b.embedding.to_list()) @ c.T), axis=1)[:, :probes]
            yield pd.DataFrame({"chunk_id": b.chunk_id, "embedding": b.embedding, "near": list(near.astype(np.int32))})

    placed = stored(unit.mapInPandas(assign, f"chunk_id {kind}, embedding array<double>, near array<int>"))
    own = placed.select("chunk_id", "embedding", F.col("near")[0].alias("list"))
    sizes = own.groupBy("list").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))  # one row a list
    held = own.join(F.broadcast(sizes), "list").withColumn("part", F.pmod(F.xxhash64("chunk_id"), "blocks").cast("int"))
    looks = placed.select(F.col("chunk_id").alias("query_id"), "embedding", F.explode("near").alias("list")).join(F.broadcast(sizes), "list")
    looks = looks.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def meet(key, left, right):
        left, right = left.rename(columns=lambda c: c[2:]), right.rename(columns=lambda c: c[2:])
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "chunk_id": [], "score": []})
        c, ids, out = np.stack(right.embedding.to_list()), right.chunk_id.to_numpy(), []
        for at in range(0, len(left), 1000):
            asked = left.query_id.to_numpy()[at : at + 1000]
            scores = np.round(np.stack(left.embedding.iloc[at : at + 1000].to_list()) @ c.T, 6)
            scores[asked[:, None] == ids[None, :]] = -np.inf
            if least is not None:
                scores[scores < least] = -np.inf
            n = min(k, scores.shape[1])
            cut = np.partition(scores, -n, axis=1)[:, -n]
            q, j = np.nonzero((scores >= cut[:, None]) & (scores > -np.inf))
            out.append(pd.DataFrame({"query_id": asked[q], "chunk_id": ids[j], "score": scores[q, j]}))
        return pd.concat(out, ignore_index=True)

    # those who look are as many as all vectors in a hot list: they are cut as well, each part meeting the whole block
    looks = looks.withColumn("turn", F.pmod(F.xxhash64("query_id", F.lit(1)), F.col("blocks")).cast("int"))
    held = held.withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keys = ["list", "part", "turn"]
    left, right = ["query_id", "embedding", *keys], ["chunk_id", "embedding", *keys]
    looks, held = looks.toDF(*looks.columns).select(left).toDF(*[f"l_{c}" for c in left]), held.select(right).toDF(*[f"r_{c}" for c in right])
    out = looks.groupBy(*[f"l_{c}" for c in keys]).cogroup(held.groupBy(*[f"r_{c}" for c in keys])).applyInPandas(meet, f"query_id {kind}, chunk_id {kind}, score double")
    return ranked(out, k)


def min_max(lists: DataFrame) -> DataFrame:
    """score of each (query_id, signal) list scaled to 0..1; lists of equal scores become 1."""
    w = Window.partitionBy("query_id", "signal")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return lists.withColumn("normalized", F.when(high == low, F.lit(1.0)).otherwise((F.col("score") - low) / (high - low)))


def reciprocal_rank_fusion(lists: DataFrame, k: int = 20, top: int | None = 10) -> DataFrame:
    """(query_id, chunk_id, score, rank) of ranked lists (query_id, signal, chunk_id, rank): a union and one grouping, not an outer join."""
    fused = lists.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"))
    return ranked(fused, top)


def best_of_sub_queries(lists: DataFrame, final: int = 10) -> DataFrame:
    """(query_id, chunk_id, score, rank) from lists (query_id, part, parts, chunk_id, score, rank): each sub-query keeps
    max(3, final / parts) + 2 results, a chunk its best score, and the query its best final."""
    cut = lists.where(F.col("rank") <= F.greatest(F.lit(3), F.floor(final / F.col("parts"))) + 2)
    return ranked(cut.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score")), final)


def evidence(results: DataFrame, limit: int = 5) -> DataFrame:
    """Selected results (query_id, chunk_id, score, rule_number, section_title, place): each id once by its best score, those with a
    rule first, then by score."""
    once = results.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy(F.desc("score")))).where("n = 1").drop("n")
    order = Window.partitionBy("query_id").orderBy(F.when(F.coalesce("rule_number", F.lit("")) != "", 0).otherwise(1), F.desc("score"), "chunk_id")
    return once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def diversity(selected: DataFrame) -> DataFrame:
    """(query_id, n, diversity, rules): half the share of distinct rules and sections, 1 for up to one result; rules in order of place."""
    rule, section = F.nullif("rule_number", F.lit("")), F.nullif("section_title", F.lit(""))
    rules = F.array_distinct(F.filter(F.transform(F.sort_array(F.collect_list(F.struct("place", "rule_number"))), lambda x: x.rule_number), lambda r: r.isNotNull() & (r != "")))
    out = selected.groupBy("query_id").agg(F.count("*").alias("n"), F.count_distinct(rule).alias("r"), F.count_distinct(section).alias("s"), rules.alias("rules"))
    return out.select("query_id", "n", F.round(F.when(F.col("n") <= 1, 1.0).otherwise((F.col("r") / F.col("n") + F.col("s") / F.col("n")) / 2), 6).alias("diversity"), "rules")


def coverage(tasks: DataFrame, results: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(query_id, tasks, covered, score): the share of sub-tasks (query_id, task) with a result whose mixed tokens hold at least
    threshold of the task's. Tasks without tokens aren't covered."""
    t = tasks.select("query_id", "task", T.mixed_tokens("task").alias("want"))
    r = results.select("query_id", T.mixed_tokens("text").alias("have"))
    hit = F.size(F.array_intersect("want", "have")) >= threshold * F.size("want")
    met = t.join(r, "query_id", "left").groupBy("query_id", "task").agg(F.coalesce(F.bool_or(hit & (F.size("want") > 0)), F.lit(False)).alias("ok"))
    return met.groupBy("query_id").agg(F.count("*").alias("tasks"), F.count_if("ok").alias("covered"), F.round(F.avg(F.col("ok").cast("double")), 6).alias("score"))
