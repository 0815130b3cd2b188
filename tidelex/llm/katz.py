"""Katz backoff language model over a whole corpus, and the score of every text under it.

Counts live in partitioned blocks: the shard that owns a range of hashed words holds their counts, and the shard that
owns a history holds all n-grams that start with it, so both the counts and the sums that normalise a history are
whole within one shard. Documents are dealt into chunks. A chunk sends its distinct n-grams with their training counts
to their shards (those that own any of them) and gets back the corpus-wide counts and, per history, what its backoff
weight is made of. A word's place in its shard is its short id, by which pairs are sent. Each shard's counts of counts,
one short row, are added up by Spark, and the sums (a few numbers) go to every chunk for the Good-Turing discounts.

    P(t | h) = d(c(h,t)) c(h,t) / c(h)      if the pair was seen in training
             = a(h) P(t)                    if not, with a(h) = (1 - sum of the above) / (1 - sum of P over seen t)
    P(t)     = d(c(t)) c(t) / N             if t was seen; all unseen tokens together share the mass left over

Both levels add up to 1 over the training vocabulary and the class of unseen tokens. d(r) is the Good-Turing discount
for r up to 5 and 1 above it. A history of which every count is above 5 has nothing left over; its counts are then
divided by c(h) + 1, and the same is done for P(t) if no token occurs 1 to 5 times.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelex.llm.blocks import U, chunked, distinct_hashes, mix, pack, pack_sorted, shard_bounds, split_words, unpack, unpack_sorted

TOP = 5
#: The chunk of the rows that hold a shard's counts of counts.
STATS = -1
START, END = U(0x5EED5EED5EED0001), U(0x5EED5EED5EED0002)


def discounts(n: np.ndarray) -> np.ndarray:
    """d[1..TOP] from counts of counts n[1..TOP + 1]; d[0] is unused.

    Katz's formula with the largest cut-off for which all discounts lie in (0, 1]; counts above it stay whole. If
    there is none, as in tiny or odd corpora, counts up to TOP lose half an occurrence.
    """
    for k in range(TOP, 0, -1):
        if (n[1 : k + 2] > 0).all():
            r = np.arange(1, k + 1)
            over = (k + 1) * n[k + 1] / n[1]
            d = ((r + 1) * n[2 : k + 2] / n[1 : k + 1] / r - over) / (1 - over) if over < 1 else np.zeros(k)
            if ((d > 0) & (d <= 1)).all():
                return np.r_[1.0, d, np.ones(TOP - k)]
    return np.r_[1.0, 1 - 0.5 / np.arange(1, TOP + 1)]


def counts_of_counts(c: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(c, TOP + 2).astype(np.int64), minlength=TOP + 3)[: TOP + 2]


class Unigrams:
    """P(t) from counts of counts, N and V."""

    def __init__(self, n: np.ndarray, total: int):
        self.d = discounts(n)
        r = np.arange(1, TOP + 1)
        left = float(((1 - self.d[1:]) * r * n[1 : TOP + 1]).sum())
        self.total = total if left > 0 else total + 1
        self.unseen = (left if left > 0 else 1.0) / self.total

    def mass(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > TOP, c, self.d[np.minimum(c, TOP)] * c) / self.total

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.mass(c), self.unseen)


def pair_probability(c_pair: np.ndarray, p_token: np.ndarray, c_hist: np.ndarray, seen_by_count: np.ndarray, tokens_by_count: np.ndarray, tokens_rest: np.ndarray, d2: np.ndarray, uni: Unigrams) -> np.ndarray:
    """P(t | h) of rows of pairs; the histories' columns are already taken to the rows.

    seen_by_count[:, r - 1]: tokens seen after h exactly r times; tokens_by_count[:, r - 1]: of the tokens seen after
    h those with r occurrences in all; tokens_rest: all occurrences of the other tokens seen after h.
    """
    r = np.arange(1, TOP + 1)
    left = ((1 - d2[1:]) * r * seen_by_count).sum(axis=1)
    whole = np.where(left > 0, c_hist, c_hist + 1)
    left = np.where(left > 0, left, 1.0)
    seen = ((tokens_by_count * (uni.d[1:] * r)).sum(axis=1) + tokens_rest) / uni.total
    back = left / whole / np.maximum(1 - seen, uni.unseen)
    direct = np.where(c_pair > TOP, c_pair, d2[np.minimum(c_pair, TOP)] * c_pair) / np.maximum(whole, 1)
    return np.where(c_hist == 0, p_token, np.where(c_pair > 0, direct, back * p_token))


class Chunk:
    """The tokens of a chunk as places in its sorted list of distinct keys."""

    def __init__(self, group: pa.Table):
        parts, words, counts = split_words(group["text"].to_pylist(), lower=True)
        del parts
        self.docs = len(counts)
        last = np.cumsum(counts + 1) - 1  # where the ends go
        own, of = distinct_hashes(words)
        self.keys, place = np.unique(np.r_[own, START, END], return_inverse=True)
        self.token = np.full(len(words) + self.docs, place[-1])
        body = np.ones(len(self.token), bool)
        body[last] = False
        self.token[body] = place[:-2][of]
        self.doc = np.repeat(np.arange(self.docs), counts + 1)
        self.history = np.empty_like(self.token)
        self.history[1:] = self.token[:-1]
        self.history[last[:-1] + 1] = self.history[:1] = place[-2]
        self.train = group["train"].to_numpy(zero_copy_only=False).astype(bool)[self.doc]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct pair codes, each token's place among them, and their training counts."""
        codes, place = np.unique(self.history * len(self.keys) + self.token, return_inverse=True)
        return codes, place, np.bincount(place[self.train], minlength=len(codes))


def _summed(asked: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, one place of each, their counts over all chunks, and the places of all asked keys."""
    held, first, place = np.unique(np.concatenate(asked), return_index=True, return_inverse=True)
    return held, first, np.bincount(place, weights=np.concatenate(counts), minlength=len(held)).astype(np.int64), place


def _split(x: np.ndarray, like: list[np.ndarray]) -> list[np.ndarray]:
    return np.split(x, np.cumsum([len(a) for a in like])[:-1])


def katz_scores(docs: DataFrame, train) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, train per row of ``docs``.

    ``train`` (a boolean Column; null: true) marks the rows to learn from. Tokens are the words of the text, A-Z
    lower-cased, and one end per text; a null text has the end only. Repeated rows count each. ``score`` is the
    log10 probability of the text under the bigram model, ``base_score`` under add-one unigrams. Without training
    rows every token is of the unseen class, whose probability is 1. An empty table gives no rows. Very long texts are
    scored whole. Besides what ``train`` reads only doc_id and text are read, so other columns may have any names.
    """
    rows, n_chunks, n = chunked(docs, extra=[F.coalesce(train, F.lit(True)).alias("train")])

    def ask_words(key: tuple, group: pa.Table) -> pa.Table:
        chunk = Chunk(group)
        count = np.bincount(chunk.token[chunk.train], minlength=len(chunk.keys)).astype(np.int32)
        at = shard_bounds(chunk.keys, n)
        used = [s for s in range(n) if at[s] < at[s + 1]]
        return pa.table({
            "shard": pa.array(used, pa.int32()),
            "asker": pa.array([key[0].as_py()] * len(used), pa.int32()),
            "keys": pa.array([pack_sorted(chunk.keys[at[s] : at[s + 1]]) for s in used], pa.binary()),
            "counts": pa.array([pack(count[at[s] : at[s + 1]]) for s in used], pa.binary()),
        })

    def answers(level: int, group: pa.Table, counts: list[bytes], histories: list[bytes], stats: np.ndarray) -> pa.Table:
        m = len(counts)
        return pa.table({
            "chunk": pa.array([*group["asker"].to_pylist(), STATS], pa.int32()), "level": pa.array([level] * (m + 1), pa.int32()), "shard": pa.array([*group["shard"].to_pylist(), STATS], pa.int32()),
            "counts": pa.array([*counts, b""], pa.binary()), "histories": pa.array([*histories, b""], pa.binary()), "stats": pa.array([*[None] * m, stats.tolist()], pa.list_(pa.int64())),
        })

    def told_all(frame: DataFrame, level: int) -> DataFrame:
        """The answers, and for each chunk one row with the sums of all shards' counts of counts."""
        sums = frame.where(F.col("chunk") == STATS).select(F.posexplode("stats").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x"))
        one = sums.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("stats"))
        chunks = docs.sparkSession.range(n_chunks).select(F.col("id").cast("int").alias("chunk"))  # one is a single row of a few numbers
        rows = chunks.join(F.broadcast(one), F.lit(True)).select("chunk", F.lit(level).alias("level"), F.lit(STATS).alias("shard"), F.lit(b"").alias("counts"), F.lit(b"").alias("histories"), "stats")
        return frame.where(F.col("chunk") != STATS).unionByName(rows)

    def sums_of(told: pa.Table, level: int) -> np.ndarray:
        return np.array(told.filter((pc.field("shard") == STATS) & (pc.field("level") == level))["stats"][0].as_py(), np.int64)

    def ranked(told: pa.Table, level: int) -> list[dict]:
        return sorted(told.filter((pc.field("shard") != STATS) & (pc.field("level") == level)).drop_columns("stats").to_pylist(), key=lambda x: x["shard"])

    def answer_words(key: tuple, group: pa.Table) -> pa.Table:
        asked = [unpack_sorted(x) for x in group["keys"].to_pylist()]
        _, _, total, place = _summed(asked, [unpack(x, np.int32) for x in group["counts"].to_pylist()])
        ids = [pack(np.diff(x, prepend=0)) for x in _split(place, asked)]
        stats = np.r_[counts_of_counts(total), total.sum(), (total > 0).sum()].astype(np.int64)
        return answers(1, group, [pack(x) for x in _split(total[place], asked)], ids, stats)

    def words_known(told: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Corpus counts and ids of the chunk's keys; ids grow with the keys."""
        rows = ranked(told, 1)
        ids = [np.cumsum(unpack(x["histories"], np.int64)).astype(U) | U(x["shard"] << 32) for x in rows]
        return np.concatenate([unpack(x["counts"], np.int64) for x in rows]), np.concatenate(ids)

    def ask_pairs(key: tuple, group: pa.Table, told: pa.Table) -> pa.Table:
        if not group.num_rows:
            return pa.table({"shard": pa.array([], pa.int32()), "asker": pa.array([], pa.int32())} | {k: pa.array([], pa.binary()) for k in ("histories", "sizes", "tokens", "counts", "known")})
        chunk = Chunk(group)
        known, ids = words_known(told)
        codes, _, count = chunk.pairs()
        first, second = codes // len(chunk.keys), codes % len(chunk.keys)
        hist, begin = np.unique(first, return_index=True)
        size = np.diff(np.r_[begin, len(codes)])
        at = shard_bounds(chunk.keys[hist], n)
        out: dict[str, list] = {k: [] for k in ("histories", "sizes", "tokens", "counts", "known")}
        used = [s for s in range(n) if at[s] < at[s + 1]]
        for s in used:
            h = slice(at[s], at[s + 1])
            p = slice(begin[at[s]] if at[s] < len(begin) else len(codes), begin[at[s + 1]] if at[s + 1] < len(begin) else len(codes))
            out["histories"].append(pack_sorted(chunk.keys[hist[h]]))
            out["sizes"].append(pack(size[h].astype(np.int32)))
            out["tokens"].append(pack(np.diff(ids[second[p]], prepend=U(0))))
            out["counts"].append(pack(count[p].astype(np.int32)))
            out["known"].append(pack(known[second[p]]))
        return pa.table({"shard": pa.array(used, pa.int32()), "asker": pa.array([key[0].as_py()] * len(used), pa.int32())} | {k: pa.array(v, pa.binary()) for k, v in out.items()})

    def answer_pairs(key: tuple, group: pa.Table) -> pa.Table:
        hist = [unpack_sorted(x) for x in group["histories"].to_pylist()]
        of = [np.repeat(h, unpack(x, np.int32)) for h, x in zip(hist, group["sizes"].to_pylist(), strict=True)]
        asked = [mix(h * U(3) + mix(np.cumsum(unpack(x, U), dtype=U))) for h, x in zip(of, group["tokens"].to_pylist(), strict=True)]
        _, first, total, place = _summed(asked, [unpack(x, np.int32) for x in group["counts"].to_pylist()])
        seen = total > 0
        own, mine = np.unique(np.concatenate(hist), return_inverse=True)
        at = np.searchsorted(own, np.concatenate(of)[first[seen]])
        c, token = total[seen], np.concatenate([unpack(x, np.int64) for x in group["known"].to_pylist()])[first[seen]]
        columns = [np.bincount(at, weights=c, minlength=len(own))]
        columns += [np.bincount(at[c == r], minlength=len(own)) for r in range(1, TOP + 1)]
        columns += [np.bincount(at[token == r], minlength=len(own)) for r in range(1, TOP + 1)]
        columns += [np.bincount(at[token > TOP], weights=token[token > TOP], minlength=len(own))]
        about = np.stack(columns, axis=1).astype(np.int64)
        return answers(2, group, [pack(x) for x in _split(total[place], asked)], [pack(about[x].reshape(-1)) for x in _split(mine, hist)], counts_of_counts(total))

    def scored(key: tuple, group: pa.Table, told: pa.Table) -> pa.Table:
        if not group.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "train": pa.array([], pa.bool_())} | {k: pa.array([], pa.int64()) for k in ("n_tokens", "n_known", "train_tokens")} | {k: pa.array([], pa.float64()) for k in ("base_score", "score")})
        chunk = Chunk(group)
        stats, d2 = sums_of(told, 1), discounts(sums_of(told, 2))
        total, kinds = int(stats[-2]), int(stats[-1])
        uni = Unigrams(stats[: TOP + 2], total)
        known, _ = words_known(told)
        pairs = ranked(told, 2)
        c_pair = np.concatenate([unpack(x["counts"], np.int64) for x in pairs])
        about = np.concatenate([unpack(x["histories"], np.int64) for x in pairs]).reshape(-1, 2 * TOP + 2)
        codes, place, _ = chunk.pairs()
        hist, of = np.unique(codes // len(chunk.keys), return_inverse=True)
        second = codes % len(chunk.keys)
        p = np.empty(len(codes))
        for at in range(0, len(codes), 1 << 18):
            part = slice(at, at + (1 << 18))
            h = about[of[part]]
            p[part] = pair_probability(c_pair[part], uni.p(known[second[part]]), h[:, 0], h[:, 1 : TOP + 1], h[:, TOP + 1 : 2 * TOP + 1], h[:, -1], d2, uni)
        c = known[chunk.token]
        by_doc = lambda x: np.bincount(chunk.doc, weights=x, minlength=chunk.docs)
        return pa.table({
            "doc_id": group["doc_id"], "train": group["train"], "n_tokens": pa.array(np.bincount(chunk.doc, minlength=chunk.docs), pa.int64()), "n_known": pa.array(by_doc(c > 0).astype(np.int64)),
            "train_tokens": pa.array([total] * chunk.docs, pa.int64()), "base_score": pa.array(by_doc(np.log10((c + 1) / (total + kinds + 1)))), "score": pa.array(by_doc(np.log10(p)[place])),
        })

    schema = "chunk int, level int, shard int, counts binary, histories binary, stats array<long>"
    asked = rows.groupBy("chunk").applyInArrow(ask_words, "shard int, asker int, keys binary, counts binary")
    words = asked.groupBy("shard").applyInArrow(answer_words, schema)
    heard = words.where(F.col("chunk") != STATS)
    asked = rows.groupBy("chunk").cogroup(heard.groupBy("chunk")).applyInArrow(ask_pairs, "shard int, asker int, histories binary, sizes binary, tokens binary, counts binary, known binary")
    pairs = asked.groupBy("shard").applyInArrow(answer_pairs, schema)
    out = "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.groupBy("chunk").cogroup(told_all(words, 1).unionByName(told_all(pairs, 2)).groupBy("chunk")).applyInArrow(scored, out)
