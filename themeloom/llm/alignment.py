"""Alignment of two tokenizers over the same texts.

A byte-level BPE (A, of the ``tokenizers`` library) encodes ``" " + text``, a SentencePiece BPE (B) the text,
to which it adds the space itself. **Groups:** the cumulative ends of both id lists, in bytes, are
keys of two dictionaries to token indices; the keys that both have, sorted, slice the lists into
groups of the same bytes. **Links:** inside each slice every A token is linked to every B token
that ends where it ends. **Strength:** the number of links of an id pair in the whole corpus, and whether it
is the highest of its B id.

A text is cut before every space that follows no white space. Neither tokenizer has a token across
such a place: A splits there before it merges, and no piece of B has a space after another
character. So a worker aligns each different cut once (a bounded number is remembered),
new cuts of a batch in one call of each library. Where A isn't of that kind, texts aren't cut.

Two linked tokens end together, so the bytes of one are a suffix of the other's: ``link_bound``
counts the pairs of that kind, which limits the table of link counts whatever the corpus (0.2
million for the given files). Only this table is collected and broadcast.

Defined results: a text that is null, empty or not given back byte by byte by the tokens of both (a text with
U+2581) has no tokens, groups or links. Special tokens inside texts are plain text. Texts may be of any
length; repeated rows are aligned each; an empty table has no links.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.lineage import Workspace
from themeloom.llm import pieces
from themeloom.llm.tokens import batch_udf

MEMORY = 250_000  # cuts in each of two generations that a worker keeps
CALL = 1 << 18  # characters of new cuts encoded in one call
LONG = 256  # characters of a cut up to which it is remembered
CODES = 1 << 22

ALIGNED = "struct<n_a: bigint, n_b: bigint, n_groups: bigint, n_links: bigint, groups: string, links: binary>"

_CUT = re.compile(r"(?<=\S)(?= )")


def byte_alphabet() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte: itself, or one from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + k): b for k, b in enumerate(other)}}


class Aligner:
    """Both tokenizers, the bytes of their tokens and the alignments of cuts."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        with open(path_a) as file:
            spec = json.load(file)
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet = byte_alphabet()
        names = {i: t for t, i in self.a.get_vocab().items()}
        special = {t["content"]: t["content"].encode() for t in spec.get("added_tokens") or []}
        self.bytes_a = [special.get(names.get(i, "")) or bytes(map(alphabet.__getitem__, names.get(i, ""))) for i in range(max(names) + 1)]
        rules = pieces.model(path_b)
        single = {i: bytes([b]) for b, i in rules.bytes.items()}
        self.bytes_b = [single.get(i) or p.replace(pieces.SPACE, " ").encode() for i, p in enumerate(rules.pieces)]
        self.n_b = len(self.bytes_b)
        self.size_a, self.size_b = (np.array([len(x) for x in own]) for own in (self.bytes_a, self.bytes_b))
        if not rules.prefix or rules.squeeze or len(rules.map.units):
            raise ValueError("the second model must add a space and change nothing else")
        split = spec.get("pre_tokenizer") or {}
        self.cuts = spec.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        self.lone = [self.b.piece_to_id(pieces.SPACE)]
        self.written_a, self.written_b = ([str(i) for i in range(len(own))] for own in (self.bytes_a, self.bytes_b))
        self._new: dict[str, tuple] = {}
        self._old: dict[str, tuple] = {}

    # --- one stretch ---------------------------------------------------------------------------

    def encode(self, spaced: str) -> tuple[list[int], list[int]]:
        """Ids of a stretch that begins with the added space."""
        ids_b = self.b.encode(spaced[1:]) if len(spaced) > 1 else self.lone
        return self.a.encode(spaced, add_special_tokens=False).ids, ids_b

    def slices(self, ids_a: list[int], ids_b: list[int]) -> tuple[list[int], list[int], list[int]]:
        """Ends in bytes, tokens of A and tokens of B up to each place where both end."""
        end_a = dict(zip(np.cumsum(self.size_a[ids_a]).tolist(), range(1, len(ids_a) + 1)))
        end_b = dict(zip(np.cumsum(self.size_b[ids_b]).tolist(), range(1, len(ids_b) + 1)))
        ends = sorted(end_a.keys() & end_b.keys())
        return ends, [end_a[e] for e in ends], [end_b[e] for e in ends]

    def same_bytes(self, spaced: str, ids_a: list[int], ids_b: list[int]) -> bool:
        raw = spaced.encode()
        return b"".join(map(self.bytes_a.__getitem__, ids_a)) == raw == b"".join(map(self.bytes_b.__getitem__, ids_b))

    def _align(self, cuts: list[str]) -> list[tuple | None] | None:
        """What ``lookup`` returns of cuts that are encoded as one stretch; None if its bytes aren't given back."""
        stretch = "".join(cuts)
        ids_a, ids_b = self.encode(stretch)
        if not self.same_bytes(stretch, ids_a, ids_b):
            return None
        ends, to_a, to_b = self.slices(ids_a, ids_b)
        name_a, name_b = [self.written_a[i] for i in ids_a], [self.written_b[i] for i in ids_b]
        groups = [
            f"{name_a[x]}|{name_b[y]}" if p - x == 1 == q - y else ",".join(name_a[x:p]) + "|" + ",".join(name_b[y:q])
            for x, p, y, q in zip([0, *to_a], to_a, [0, *to_b], to_b)
        ]
        # Tokens are not empty, so only the last ones of a slice end with it.
        last_a, last_b = np.array(ids_a)[np.array(to_a) - 1], np.array(ids_b)[np.array(to_b) - 1]
        links = (last_a * self.n_b + last_b).astype(np.uint32).tobytes()
        edges = np.cumsum([len(c.encode()) for c in cuts])
        at = np.searchsorted(ends, edges)
        if (np.append(ends, -1)[at] != edges).any():
            return None
        at = [0, *(at + 1).tolist()]
        n_a = np.diff([0, *(to_a[g - 1] for g in at[1:])]).tolist()
        n_b = np.diff([0, *(to_b[g - 1] for g in at[1:])]).tolist()
        return [(x, y, ";".join(groups[g:h]), links[4 * g : 4 * h]) for x, y, g, h in zip(n_a, n_b, at, at[1:])]

    # --- many texts ----------------------------------------------------------------------------

    def _learn(self, cuts: list[str]) -> None:
        """Aligns new cuts. What ends in white space or has the mark of a space is encoded alone."""
        alone = [c for c in cuts if c[-1].isspace() or pieces.SPACE in c or not self.cuts]
        joined = set(cuts) - set(alone)
        batch, size = [], 0
        for cut in [*joined, None]:
            if batch and (cut is None or size + len(cut) > CALL):
                found = self._align(batch)
                if found is None:
                    alone += batch
                else:
                    self._new.update(zip(batch, found))
                batch, size = [], 0
            if cut is not None:
                batch.append(cut)
                size += len(cut)
        for cut in alone:
            found = self._align([cut])
            self._new[cut] = found[0] if found else None

    def align(self, texts: list[str | None]) -> list[tuple]:
        """(tokens of A, of B, the groups as text, the links as packed ``a * n_b + b``) of every text."""
        split = [(_CUT.split(" " + t) if self.cuts else [" " + t]) if t else [] for t in texts]
        known, old = self._new, self._old
        fresh = []
        for cut in set().union(*split).difference(known):
            if cut in old:
                known[cut] = old[cut]
            else:
                fresh.append(cut)
        self._learn(fresh)
        out = []
        for own in split:
            found = [known[c] for c in own]
            if not found or None in found:
                out.append((0, 0, "", b""))
            else:
                n_a, n_b, groups, links = zip(*found)
                out.append((sum(n_a), sum(n_b), ";".join(groups), b"".join(links)))
        for cut in fresh:
            if len(cut) > LONG:
                del known[cut]
        if len(known) > MEMORY:
            self._new, self._old = {}, known
        return out

    def link_bound(self) -> int:
        """Number of id pairs of which one's bytes are a suffix of the other's."""

        def held(own: list[bytes]) -> dict[bytes, int]:
            count: dict[bytes, int] = {}
            for raw in own:
                count[raw] = count.get(raw, 0) + 1
            return count

        in_a, in_b = held(self.bytes_a), held(self.bytes_b)
        shorter_b = sum(n * in_b.get(raw[k:], 0) for raw, n in in_a.items() for k in range(len(raw)))
        return shorter_b + sum(n * in_a.get(raw[k:], 0) for raw, n in in_b.items() for k in range(1, len(raw)))


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def aligned(path_a: str, path_b: str):
    """Arrow UDF from a text to its alignment; both files must be readable by every executor.

    ``groups`` is written ``a1,a2|b1;a3|b2,b3``, see ``as_groups``; ``links`` is packed, see ``as_links``.
    """
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.large_string(), pa.binary())

    def make(texts: pa.Array) -> pa.Array:
        # A group has one link, since no token is empty.
        made = aligner(path_a, path_b).align(texts.to_pylist())
        rows = [(n_a, n_b, len(links) // 4, len(links) // 4, groups, links) for n_a, n_b, groups, links in made]
        columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
        columns[4] = columns[4].cast(pa.string())
        return pa.StructArray.from_arrays(columns, ["n_a", "n_b", "n_groups", "n_links", "groups", "links"])

    return batch_udf(ALIGNED, make)


def as_groups(groups: Column) -> Column:
    """Written groups as an array of structs of two id arrays."""

    def ids(side: Column) -> Column:
        return F.split(side, ",").cast("array<int>")

    each = F.transform(
        F.split(groups, ";"),
        lambda g: F.struct(ids(F.substring_index(g, "|", 1)).alias("a"), ids(F.substring_index(g, "|", -1)).alias("b")),
    )
    return F.when(groups == "", F.array().cast("array<struct<a: array<int>, b: array<int>>>")).otherwise(each)


def as_links(links: Column, n_b: int) -> Column:
    """Packed links as an array of id pairs, in order of the text."""

    def make(packed: pa.Array) -> pa.Array:
        codes = [np.frombuffer(raw or b"", np.uint32).astype(np.int64) for raw in packed.to_pylist()]
        flat = np.concatenate([np.zeros(0, np.int64), *codes])
        pairs = pa.StructArray.from_arrays([pa.array((flat // n_b).astype(np.int32)), pa.array((flat % n_b).astype(np.int32))], ["a", "b"])
        edges = np.concatenate([[0], np.cumsum([len(c) for c in codes])])
        return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pairs)

    return batch_udf("array<struct<a: int, b: int>>", make)(links)


def _count_task(batches):
    """Occurrences of the links of a task; a row for each pair."""
    codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def fold(parts: list[bytes]):
        fresh, n = np.unique(np.frombuffer(b"".join(parts), np.uint32), return_counts=True)
        both, place = np.unique(np.concatenate([codes, fresh.astype(np.int64)]), return_inverse=True)
        out = np.zeros(len(both), np.int64)
        np.add.at(out, place, np.concatenate([counts, n]))
        return both, out

    parts, size = [], 0
    for batch in batches:
        for links in batch["links"].to_pylist():
            parts.append(links or b"")
            size += len(parts[-1])
            if size >= CODES:
                codes, counts = fold(parts)
                parts, size = [], 0
    codes, counts = fold(parts)
    yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts)], ["code", "n"])


def link_counts(docs: DataFrame, links: Column, n_b: int) -> DataFrame:
    """Rows (a, b, n) of every linked id pair; tasks add up their own links before the shuffle."""
    counted = docs.select(links.alias("links")).mapInArrow(_count_task, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))
    return counted.select(F.expr(f"code div {n_b}").cast("int").alias("a"), F.expr(f"code % {n_b}").cast("int").alias("b"), "n")


def strength(counts: DataFrame, links: Column, path_a: str, path_b: str) -> Column:
    """Struct (n_best, count_sum) of packed links: how many are the most frequent of their B id, and their counts added.

    ``counts`` holds at most ``link_bound`` rows, so it may come to the driver.
    """
    own = aligner(path_a, path_b)
    n_b = own.n_b
    if counts.count() > own.link_bound():
        raise ValueError("more id pairs than the vocabularies can link")
    found = counts.toArrow()
    b, n = found["b"].to_numpy(), found["n"].to_numpy()
    codes = found["a"].to_numpy().astype(np.int64) * n_b + b
    best = np.zeros(n_b, np.int64)
    np.maximum.at(best, b, n)
    order = np.argsort(codes)
    table = counts.sparkSession.sparkContext.broadcast((codes[order].astype(np.uint32), n[order], (n == best[b])[order]))

    def make(packed: pa.Array) -> pa.Array:
        codes, n, top = table.value
        rows = []
        for raw in packed.to_pylist():
            at = np.searchsorted(codes, np.frombuffer(raw or b"", np.uint32))
            rows.append((int(top[at].sum()), int(n[at].sum())))
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], ["n_best", "count_sum"])

    return batch_udf("struct<n_best: bigint, count_sum: bigint>", make)(links)


def align_documents(docs: DataFrame, path_a: str, path_b: str, text: str = "text", into: str = "aligned") -> DataFrame:
    """The rows of ``docs`` with a struct ``into``: the fields of ``ALIGNED``, ``n_best`` and ``count_sum``.

    Alignments are stored once: the counts of links are taken from that table, and so are the results.
    """
    if into.lower() in [c.lower() for c in docs.columns]:
        raise ValueError(f"the documents have a column {into!r}")
    made = docs.select(F.struct("*").alias("row"), aligned(path_a, path_b)(F.col(text)).alias("own"))
    return with_strength(made, path_a, path_b).select("row.*", F.col("own").alias(into))


def with_strength(made: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Rows (row, own), ``own`` a struct with ``links``, to which ``n_best`` and ``count_sum`` are added."""
    work = Workspace(made.sparkSession, "alignment")
    held = work.save(made, "aligned")
    counts = work.save(link_counts(held, F.col("own.links"), aligner(path_a, path_b).n_b), "counts")
    more = held.select("row", "own", strength(counts, F.col("own.links"), path_a, path_b).alias("more"))
    fields = [F.col(f"own.{f}").alias(f) for f in held.schema["own"].dataType.names]
    return more.select("row", F.struct(*fields, "more.n_best", "more.count_sum").alias("own"))
