"""Katz backoff language model of any order from two on: Good-Turing counts, exactly normalised backoff weights, tables in shards.

P(w | h) = d(c(h w)) c(h w) / c(h) for k-grams seen in training, and alpha(h) P(w | h') for the others, h' being h without its first word, with alpha(h) = (1 - sum of the
discounted seen k-grams) / (1 - sum of P(w | h') over the words seen after h), and 1 for an h that training never saw. The recursion ends at P(w) = d(c(w)) c(w) / N, where all words never
seen share the rest as one type. Evaluation is that recursion for every token. A text is preceded by as many start signs as a history holds.

Discounts are Good-Turing's up to a count of ``CUT``, for each order by its own counts of counts, d(r) = (r* / r - x) / (1 - x) with r* = (r + 1) N(r+1) / N(r) and x = (CUT + 1) N(CUT+1) / N(1). Where
the counts of counts are too thin for a value between 0 and 1, d(r) = 1 - 0.5 / r. Above CUT, d(r) = 1 - s / r with a small s, so that each history keeps some mass for what it
has not seen and every distribution adds up to one.

Texts are stored once as batches of word numbers. Each batch asks the word table (sharded by word) for counts and global word numbers, then, for each order from two on, the table of its k-grams (sharded by
history; a history with more than ``PER_SHARD`` tokens is split by word, and its sums are added up) for counts, and for the sums behind alpha where held-out texts need them. A k-gram is asked for only if its
history and its last k - 1 words were both seen in training, as its count is 0 otherwise. What a word has below the history is known by then: whatever follows a seen history is seen after the shorter
one too, so the batch sends the two counts that give its probability. Only counts of counts, shard totals and the keys and sums of the split histories reach the driver. What is counted and moved grows with the
corpus; nothing is sampled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wheelbase.llm.exchange import ask, answered, dealt, pack, sides, spread, unpack, visit
from wheelbase.llm.frames import bucket_of_id, table
from wheelbase.llm.words import BASE, U, Words, keyed, mix, pieces

CUT = 5
BATCH_BYTES = 12_000_000
PER_SHARD = 2_000_000
LEAST_SHARDS = 32
ORDER = 3
LEVEL = 1 << 40  # replies of each order go by shard + LEVEL * (order - 1)
START, END = keyed(2, 901)
SUMS = ("n1", "n2", "n3", "n4", "n5", "n_more", "more", "lower")


@dataclass
class Discounts:
    """d(r) for r up to CUT, and the mass taken from each greater count."""

    low: np.ndarray
    shift: float

    @staticmethod
    def of(counts_of_counts: np.ndarray) -> Discounts:
        """counts_of_counts[r] for r = 0..CUT + 1."""
        n = counts_of_counts.astype(float)
        x = (CUT + 1) * n[CUT + 1] / n[1] if n[1] else 1.0
        low = np.ones(CUT + 1)
        for r in range(1, CUT + 1):
            d = ((r + 1) * n[r + 1] / (r * n[r]) - x) / (1 - x) if n[r] and x < 1 else 0.0
            low[r] = d if 0 < d < 1 else 1 - 0.5 / r
        return Discounts(low, float(np.clip(CUT * (1 - low[CUT]), 0.05, 0.5)))

    def mass(self, r: np.ndarray) -> np.ndarray:
        """Discounted counts d(r) r; 0 for 0."""
        r = r.astype(float)
        return np.where(r > CUT, r - self.shift, self.low[np.minimum(r, CUT).astype(int)] * r)


def batches(docs: DataFrame) -> DataFrame:
    """(batch, body, tokens) from rows (doc_id, text, held_out): distinct word fingerprints, and each text's tokens by their place among them."""

    def make(parts):
        number = TaskContext.get().partitionId() << 32
        for whole in parts:
            for batch in pieces(whole, most=BATCH_BYTES):
                held = batch.column("held_out").to_numpy(zero_copy_only=False).astype(np.uint8)
                # Fingerprints in small parts; every text is followed by END.
                parts_ = [Words(part.column("text")) for part in pieces(batch, most=1_000_000)]
                size = np.concatenate([np.diff(p.ptr) for p in parts_]) + 1
                tokens = np.concatenate([np.insert(p.hash, p.ptr[1:], END) for p in parts_])
                vocabulary, index = np.unique(np.r_[START, END, tokens], return_inverse=True)
                count = np.bincount(index[2:][np.repeat(held == 0, size)], minlength=len(vocabulary))
                count[index[0]] = (held == 0).sum()
                # Tokens by rank, so that common words get small numbers; fingerprints by their differences. Both pack better.
                order = np.argsort(-np.bincount(index), kind="stable")
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                body = pack({"ids": batch.column("doc_id").to_numpy(), "size": size, "held": held, "step": np.diff(vocabulary, prepend=U(0)), "count": count, "start": index[:1], "order": order, "index": rank[index[2:]]})
                yield pa.record_batch({"batch": pa.array([number], pa.int64()), "body": pa.array([body], pa.binary()), "tokens": pa.array([len(tokens)], pa.int64())})
                number += 1

    return docs.mapInArrow(make, "batch long, body binary, tokens long")


def opened(body: bytes) -> dict[str, np.ndarray]:
    x = unpack(body)
    x["vocabulary"] = np.cumsum(x.pop("step").astype(U))
    x["index"] = x.pop("order").astype(np.int64)[x["index"]]
    return x


@dataclass
class Grams:
    """The distinct k-grams of a batch and the one of every token.

    ``history`` is a place among the (k - 1)-grams, or for start signs alone the place after the last; ``lower`` is the place of the last k - 1 words there, ``word`` a place in the batch's vocabulary.
    """

    history: np.ndarray
    word: np.ndarray
    lower: np.ndarray
    of_token: np.ndarray
    count: np.ndarray
    held: np.ndarray

    @staticmethod
    def of(x: dict[str, np.ndarray], order: int) -> list[Grams]:
        """Those of all orders from two up to ``order``."""
        index = x["index"].astype(np.int64)
        size = x["size"].astype(np.int64)
        first = np.cumsum(size) - size
        n = len(x["vocabulary"])
        held = np.repeat(x["held"].astype(bool), size)
        below, starts = index, int(x["start"][0])
        out = []
        for _ in range(2, order + 1):
            before = np.r_[below[:1], below[:-1]]
            before[first] = starts
            key, of_token = np.unique(before * n + index, return_inverse=True)
            lower = np.zeros(len(key), np.int64)
            lower[of_token] = below
            own = np.zeros(len(key), bool)
            own[of_token[held]] = True
            out.append(Grams(key // n, key % n, lower, of_token, np.bincount(of_token[~held], minlength=len(key)), own))
            below, starts = of_token, len(key)
        return out


def keys_of(columns: list[np.ndarray]) -> np.ndarray:
    """64-bit keys of rows of word numbers; the factor keeps the order of the words."""
    key = mix(columns[0].astype(U))
    for c in columns[1:]:
        key = mix(key * U(BASE) + mix(c.astype(U) + U(77)))
    return key


def in_order(columns: list[np.ndarray]) -> np.ndarray:
    """Places of the rows sorted by their columns of numbers from 0 up, the first before the others; equal rows in any order.

    The columns are packed into one number, as numpy sorts one several times as fast as columns in turn. What is too wide to pack is first replaced by its rank.
    """
    key = columns[0]
    for c in columns[1:]:
        width = int(c.max(initial=0)) + 1
        if (int(key.max(initial=0)) + 1) * width >= 1 << 63:
            key = np.unique(key, return_inverse=True)[1]
        key = key * width + c
    return np.argsort(key)


def changes(columns: list[np.ndarray]) -> np.ndarray:
    """Where a row differs from the one before."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def scored(docs: DataFrame, order: int = 2) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, held_out): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_backed_off.

    Learns from the rows with held_out false. A null or empty text is its end token alone. Rows without doc_id are left out. Repeated rows count and are scored as often as they occur. Without training
    rows every score is 0. An empty table gives no rows; other columns are ignored. ``order``: words in the longest k-grams, at least 2; n_backed_off counts the tokens whose longest k-gram training never saw.
    """
    made = batches(docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), "held_out"))
    held = dealt(made)
    total = held.agg(F.sum("tokens")).first()[0] or 0
    held = held.select("batch", "body")
    shards = max(LEAST_SHARDS, -(-total // PER_SHARD))

    # ---- words -------------------------------------------------------------------------------------------------------
    def word_shard(vocabulary):
        return ((vocabulary >> U(32)) * U(shards) >> U(32)).astype(np.int64)

    def words(number, body, _):
        x = opened(body)
        for shard, own, _ in spread(word_shard(x["vocabulary"]), {"word": x["vocabulary"], "count": x["count"]}):
            yield shard, {"step": np.diff(own["word"], prepend=U(0)), "count": own["count"]}

    def count_words(requests):
        word = np.concatenate([np.cumsum(r["step"].astype(U)) for r in requests])
        count = np.concatenate([r["count"] for r in requests]).astype(np.int64)
        distinct, place = np.unique(word, return_inverse=True)
        totals = np.bincount(place, weights=count, minlength=len(distinct)).astype(np.int64)
        # Global number: common words get small ones, which pack well. 0 is for words that training never saw.
        rank = np.empty(len(distinct), np.int64)
        rank[np.argsort(-totals, kind="stable")] = np.arange(len(distinct))
        code = np.where(totals > 0, rank * shards + int(word_shard(distinct[:1])[0]) + 1, 0)
        real = totals[(distinct != START) & (totals > 0)]
        split = totals > PER_SHARD
        side = {"tokens": np.array([real.sum()]), "types": np.array([len(real)]), "of_counts": np.bincount(np.minimum(real, CUT + 2), minlength=CUT + 3)[: CUT + 2], "split": code[split], "start": code[split & (distinct == START)]}
        edges = np.cumsum([0, *[len(r["step"]) for r in requests]])
        return [{"count": totals[place[a:b]], "code": code[place[a:b]]} for a, b in zip(edges, edges[1:])], side

    word_replies = answered(ask(held, None, words), count_words)
    of_shards = sides(word_replies)
    train_tokens = sum(int(s["tokens"][0]) for s in of_shards)
    types = sum(int(s["types"][0]) for s in of_shards)
    word_discounts = Discounts.of(sum((s["of_counts"].astype(np.int64) for s in of_shards), np.zeros(CUT + 2, np.int64)))
    # Keys of the histories with more than PER_SHARD tokens, for each order.
    split = {2: np.unique(keys_of([np.concatenate([s["split"].astype(np.int64) for s in of_shards])])) if of_shards else np.zeros(0, U)}
    split_start = [int(c) for s in of_shards for c in s["start"]]
    unseen = _unseen_mass(word_replies, word_discounts, train_tokens)

    def lower(count: np.ndarray) -> np.ndarray:
        """P(w) by the word's training count; 0 is the type of all unseen words."""
        if not train_tokens:
            return np.ones(len(count))
        return np.where(count > 0, word_discounts.mass(count) / train_tokens, unseen)

    def of_words(x, got):
        count, code = np.zeros(len(x["vocabulary"]), np.int64), np.zeros(len(x["vocabulary"]), np.int64)
        for shard, _, places in spread(word_shard(x["vocabulary"]), {}):
            count[places], code[places] = got[shard]["count"], got[shard]["code"]
        return count, code

    # ---- k-grams -----------------------------------------------------------------------------------------------------
    discounts, split_sums = {1: word_discounts}, {}

    def asked(k, grams, counts, columns, code):
        """The k-grams that the table can hold, their word numbers, and the shard of each; close numbers next to each other, as that packs well."""
        known = np.flatnonzero((counts[grams.history] > 0) & (counts[grams.lower] > 0))
        own = [*(c[grams.history[known]] for c in columns), code[grams.word[known]]]
        by = in_order(own)
        known, own = known[by], [c[by] for c in own]
        key = keys_of(own[:-1])
        apart = np.isin(key, split[k])
        key[apart] = mix(key[apart] + mix(own[-1][apart].astype(U) + U(77)))
        return known, own, (key % U(shards)).astype(np.int64)

    def needed(k, grams, counts, columns):
        """Histories of the batch's held-out texts whose weight may be needed, by shard."""
        own = np.unique(grams.history[grams.held])
        own = own[counts[own] > 0]
        own = own[in_order([c[own] for c in columns])]
        key = keys_of([c[own] for c in columns])
        here = ~np.isin(key, split[k])
        return own[here], (key[here] % U(shards)).astype(np.int64)

    def climbed(x, got, top):
        """For each order up to ``top``, the counts of the batch's k-grams and their word numbers; from two on, the last place is for start signs alone."""
        count, code = of_words(x, got)
        start = int(x["start"][0])
        all_, counts, columns = Grams.of(x, min(top + 1, order)), [count], [[code]]
        for k, grams in zip(range(2, top + 1), all_):
            known, _, shard = asked(k, grams, counts[-1], columns[-1], code)
            seen = np.zeros(len(grams.word), np.int64)
            for s, _, places in spread(shard, {}):
                seen[known[places]] = got[s + LEVEL * (k - 1)]["count"]
            counts.append(np.r_[seen, count[start]])
            columns.append([*(np.r_[c[grams.history], code[start]] for c in columns[-1]), np.r_[code[grams.word], code[start]]])
        return all_, counts, columns, code

    def ask_level(k):
        def ask_grams(number, body, got):
            x = opened(body)
            all_, counts, columns, code = climbed(x, got, k - 1)
            grams, counts_, columns_ = all_[k - 2], counts[-1], columns[-1]
            known, own, shard = asked(k, grams, counts_, columns_, code)
            wanted, wanted_shard = needed(k, grams, counts_, columns_)
            wants = {s: a for s, a, _ in spread(wanted_shard, {f"want{j}": c[wanted] for j, c in enumerate(columns_)})}
            # The count of the history without its first word.
            below = counts[k - 3][np.r_[all_[k - 3].lower, x["start"].astype(np.int64)[0] if k == 3 else len(counts[k - 3]) - 1]][grams.history[known]] if k > 2 else np.zeros(len(known), np.int64)
            sent = {"w": own[-1], "count": grams.count[known], "lower": counts_[grams.lower[known]], "below": below, **{f"h{j}": c for j, c in enumerate(own[:-1])}}
            parts = {s: a for s, a, _ in spread(shard, sent)}
            none = {n: np.zeros(0, np.int64) for n in sent}
            for s in sorted(set(wants) | set(parts)):
                a = parts.get(s, none)
                first = np.flatnonzero(changes([a[f"h{j}"] for j in range(k - 1)]))
                made = {"run": np.diff(np.r_[first, len(a["w"])]), "w": a["w"], "count": a["count"], "lower": a["lower"]}
                if k > 2:
                    made["below"] = a["below"][first]
                for j in range(k - 1):
                    h, want = a[f"h{j}"][first], wants[s][f"want{j}"] if s in wants else np.zeros(0, np.int64)
                    made[f"h{j}"], made[f"want{j}"] = (h, want) if j else (np.diff(h, prepend=0), np.diff(want, prepend=0))
                yield s, made

        return ask_grams

    def count_level(k):
        under = discounts[k - 1]

        def count_grams(requests):
            run = [r["run"].astype(np.int64) for r in requests]

            def column(name):
                return np.concatenate([r[name].astype(np.int64) for r in requests])

            own = [np.concatenate([np.repeat(r[f"h{j}"].astype(np.int64) if j else np.cumsum(r["h0"].astype(np.int64)), n) for r, n in zip(requests, run)]) for j in range(k - 1)]
            own.append(column("w"))
            by = in_order(own)
            own = [c[by] for c in own]
            new = changes(own)
            place = np.empty(len(by), np.int64)
            place[by] = np.cumsum(new) - 1
            own = [c[new] for c in own]
            count = np.bincount(place, weights=column("count"), minlength=len(own[0])).astype(np.int64)
            seen, more = count > 0, count > CUT
            first = changes(own[:-1])
            of_history = np.cumsum(first) - 1
            history = keys_of([c[first] for c in own[:-1]])
            low = column("lower")[by][new]
            if k == 2:
                p = lower(low)
            else:
                p = under.mass(low) / np.maximum(np.concatenate([np.repeat(r["below"].astype(np.int64), n) for r, n in zip(requests, run)])[by][new], 1)
            sums = np.zeros((len(history), len(SUMS)))
            for r in range(1, CUT + 1):
                sums[:, r - 1] = np.bincount(of_history[count == r], minlength=len(history))
            sums[:, 5] = np.bincount(of_history[more], minlength=len(history))
            sums[:, 6] = np.bincount(of_history[more], weights=count[more], minlength=len(history))
            sums[:, 7] = np.bincount(of_history[seen], weights=p[seen], minlength=len(history))
            apart = np.isin(history, split[k])
            large = count > PER_SHARD
            side = {"of_counts": np.bincount(np.minimum(count, CUT + 2), minlength=CUT + 3)[: CUT + 2], "next": keys_of([c[large] for c in own]), "split": history[apart], **{n: sums[apart, i] for i, n in enumerate(SUMS)}}
            by_key = np.argsort(history)
            sorted_ = history[by_key]
            out = []
            edges = np.cumsum([0, *[len(r["w"]) for r in requests]])
            for r, a, b in zip(requests, edges, edges[1:]):
                wants = keys_of([r[f"want{j}"].astype(np.int64) if j else np.cumsum(r["want0"].astype(np.int64)) for j in range(k - 1)])
                mine = np.zeros((len(wants), len(SUMS)))
                if len(history):
                    at = np.minimum(np.searchsorted(sorted_, wants), len(history) - 1)
                    mine = np.where((sorted_[at] == wants)[:, None], sums[by_key[at]], 0.0)
                out.append({"count": count[place[a:b]], **{n: mine[:, i] if n == "lower" else mine[:, i].astype(np.int64) for i, n in enumerate(SUMS)}})
            return out, side

        return count_grams

    both = word_replies.filter("batch >= 0")
    for k in range(2, order + 1):
        replies = answered(ask(held, both, ask_level(k)), count_level(k))
        of_grams = sides(replies)
        discounts[k] = Discounts.of(sum((s["of_counts"].astype(np.int64) for s in of_grams), np.zeros(CUT + 2, np.int64)))
        split_sums[k] = np.zeros((len(split[k]), len(SUMS)))
        for s in of_grams:
            if len(s["split"]):
                np.add.at(split_sums[k], np.searchsorted(split[k], s["split"].astype(U)), np.stack([s[n] for n in SUMS], axis=1))
        split[k + 1] = np.unique(np.concatenate([*(s["next"].astype(U) for s in of_grams), *(keys_of([np.array([c])] * k) for c in split_start), np.zeros(0, U)]))
        both = both.unionByName(replies.filter("batch >= 0").select("batch", (F.col("shard") + F.lit(LEVEL * (k - 1))).alias("shard"), "body"))

    # ---- texts -------------------------------------------------------------------------------------------------------
    def alphas(k, sums: np.ndarray, count: np.ndarray) -> np.ndarray:
        used = sums[:, :CUT] @ (discounts[k].low[1:] * np.arange(1, CUT + 1)) + sums[:, 6] - discounts[k].shift * sums[:, 5]
        return (1 - used / count) / np.maximum(1 - sums[:, 7], 1e-300)

    def finish(number, body, got):
        if not body:
            return pa.table({n: pa.array([], t) for n, t in KINDS})
        x = opened(body)
        all_, counts, columns, code = climbed(x, got, order)
        count = counts[0]
        p = lower(count)
        for k, grams in zip(range(2, order + 1), all_):
            before, numbers, seen = counts[k - 2], columns[k - 2], counts[k - 1][:-1]
            weight = np.ones(len(before))
            own, own_shard = needed(k, grams, before, numbers)
            for s, _, places in spread(own_shard, {}):
                reply = got[s + LEVEL * (k - 1)]
                weight[own[places]] = alphas(k, np.stack([reply[n].astype(float) for n in SUMS], axis=1), before[own[places]].astype(float))
            if len(split[k]):
                key = keys_of(numbers)
                apart = np.flatnonzero(np.isin(key, split[k]) & (before > 0))
                weight[apart] = alphas(k, split_sums[k][np.searchsorted(split[k], key[apart])], before[apart].astype(float))
            p = np.where(seen > 0, discounts[k].mass(seen) / np.maximum(before[grams.history], 1), weight[grams.history] * p[grams.lower])
        with np.errstate(divide="ignore", invalid="ignore"):
            value = np.log10(p)
        size = x["size"].astype(np.int64)
        first = np.cumsum(size) - size
        index = x["index"].astype(np.int64)
        base = np.log10((count + 0.1) / (train_tokens + 0.1 * (types + 1)))
        held_ = x["held"].astype(bool)
        columns = (
            x["ids"].astype(np.int64), held_, size, np.add.reduceat((count[index] > 0).astype(np.int64), first), np.full(len(size), train_tokens),
            np.add.reduceat(base[index], first), np.add.reduceat(value[grams.of_token], first), np.add.reduceat((seen[grams.of_token] == 0).astype(np.int64), first),
        )
        return pa.table({n: pa.array(c, t) for (n, t), c in zip(KINDS, columns)})

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_backed_off long"
    return visit(held, both, finish, schema)


KINDS = (
    ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()),
    ("base_score", pa.float64()), ("score", pa.float64()), ("n_backed_off", pa.int64()),
)


def _unseen_mass(replies: DataFrame, discounts: Discounts, train_tokens: int) -> float:
    """What the discounts leave for words never seen: N minus all discounted counts, over N."""
    left = 0.0
    for side in sides(replies):
        n = side["of_counts"].astype(float)
        taken = sum(n[r] * r * (1 - discounts.low[r]) for r in range(1, CUT + 1))
        left += taken + (float(side["types"][0]) - n[1:CUT + 1].sum()) * discounts.shift
    return left / train_tokens if train_tokens else 1.0


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores all rows that have a doc_id; learns from those whose crc32 remainder modulo 10 is not 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").filter("doc_id is not null")
    return scored(docs.withColumn("held_out", bucket_of_id(10) == 0), ORDER)
