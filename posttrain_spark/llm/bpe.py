"""BPE encoding and decoding with a deterministic automaton.

The automaton reads tokens.  It starts as one state with a loop for every base symbol, so that it
accepts any spelling of a word.  The merges are then applied in order, one gadget each: merge
``(a, b) -> c`` takes the ``b`` arc away from the state that ``a`` leads to (a copy of it, where
other tokens lead there too) and adds a ``c`` arc, to where ``b`` led, beside every ``a`` arc that
could be followed by ``b``.  After the last merge the automaton accepts exactly the token sequences
that merging by rank would give, one per word, and a state is known by the token that leads to it.
An arc is present or absent for good once its merge has been applied; looked-up arcs are kept in
one transition table.

A word is encoded by walking arcs whose labels spell it, the longest label first.  The automaton can
come to a place of a word in one state only, so a place from which the walk could not go on is never
entered again and the walk is linear in the word's length.  Decoding emits the arc labels.
"""

from __future__ import annotations

import json
import re
import sys
import types
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from posttrain_spark.plans.registry import query, table

WORD_END = "</w>"
# Rows handed on at once, and tokens decoded at once.
ROWS_AT_ONCE = 1_000
DECODE_TOKENS = 2_000_000
# Bounds of what a Python worker keeps between rows: arcs, and pre-split words with their tokens.
MOST_ARCS = 500_000
MOST_WORDS = 200_000


# Latin-1 characters that are letters, numbers and white space, as parts of a character class.
LATIN_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
LATIN_NUMBERS = "0-9²³¹¼½¾"
LATIN_SPACE = r"\t-\r \x85\xa0"


def byte_symbols() -> list[str]:
    """Printable stand-ins of the 256 bytes in byte-level vocabularies: printable Latin-1 characters
    stand for themselves, all other bytes for the characters from U+0100 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(others)) for b in range(256)]


# Blocks whose characters Python and the tokenizer library normalise alike: letters up to U+02FF, Greek and
# Cyrillic, punctuation and currency signs, kana, common ideographs, Hangul syllables.
SETTLED = "\x00-\u02ff\u0370-\u052f\u2000-\u206f\u20a0-\u20bf\u3000-\u3029\u3030-\u3096\u30a0-\u30ff\u4e00-\u9fa5\uac00-\ud7a3\uff00-\uffef"

_CLASSES: dict[str, str] = {}


def _ranges(runs: Iterable[str]) -> str:
    """Runs of neighbouring characters as parts of a character class."""
    return "".join(f"\\U{ord(r[0]):08X}-\\U{ord(r[-1]):08X}" for r in runs)


def library_classes() -> dict[str, str]:
    """Letters and numbers as the tokenizer library's splitter knows them, and ``odd``, the characters that
    the pattern engine used here takes for other ones: the two follow different Unicode versions.

    Both are asked about all code points, once in a driver.
    """
    if not _CLASSES:
        from tokenizers import Regex, pre_tokenizers

        # From 0 to 0x10FFFF without surrogates: a run of matches is a range of code points.
        everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        odd: set[str] = set()
        for name, kind in (("letters", r"\p{L}+"), ("numbers", r"\p{N}+")):
            split = pre_tokenizers.Split(Regex(kind), "removed", invert=True)
            runs = [run for run, _ in split.pre_tokenize_str(everything)]
            odd.symmetric_difference_update(set("".join(runs)) ^ set("".join(regex.findall(kind, everything))))
            _CLASSES[name] = _ranges(runs)
        _CLASSES["odd"] = _ranges(regex.findall("[" + "".join(map(regex.escape, odd)) + "]+", everything) if odd else [])
    return _CLASSES


class Automaton:
    """Compiled merges: ``encode`` a pre-split word to token ids."""

    def __init__(self, vocabulary: dict[str, int], merges: Iterable[tuple[str, str]]):
        self.ids = vocabulary
        self.label = {i: t for t, i in vocabulary.items()}
        # Labels by character; a node holds the token that ends there under None, and the one that
        # ends the word there under WORD_END.
        self.spelling: dict = {}
        for label, token in vocabulary.items():
            node, end = self.spelling, None
            if label.endswith(WORD_END):
                label, end = label.removesuffix(WORD_END), WORD_END
            for character in label:
                node = node.setdefault(character, {})
            node[end] = token
        self.parts: dict[int, tuple[int, int, int]] = {}  # token: left, right, rank of its merge
        self.cut: dict[tuple[int, int], int] = {}  # arc of a state: rank at which it was taken away
        self.table: dict[int, bool] = {}
        for rank, (a, b) in enumerate(merges):
            self._gadget(vocabulary[a], vocabulary[b], vocabulary[a + b], rank)

    def _gadget(self, a: int, b: int, c: int, rank: int) -> None:
        if c not in self.parts and self._present(a, b, rank):
            self.parts[c] = (a, b, rank)
            self.cut[a, b] = rank

    def _present(self, state: int, token: int, rank: int) -> bool:
        """Whether the arc leaves the state once the merges below ``rank`` are applied.

        The state of a merged token began as that of its right part; the arc of a merged token came
        with that of its left part.  Both go back to base symbols, whose arcs were all there.
        """
        while True:
            at, until = state, rank
            while True:
                if self.cut.get((at, token), until) < until:
                    return False
                if at not in self.parts:
                    break
                _, right, born = self.parts[at]
                at, until = right, min(until, born)
            if token not in self.parts:
                return True
            token, _, born = self.parts[token]
            rank = min(rank, born + 1)

    def arc(self, state: int, token: int) -> bool:
        key = state << 32 | token
        found = self.table.get(key)
        if found is None:
            if len(self.table) >= MOST_ARCS:
                self.table.clear()
            found = self.table[key] = self._present(state, token, len(self.ids))
        return found

    def encode(self, word: str) -> list[int]:
        """Token ids of a word given in byte symbols, without its end mark."""
        n = len(word)
        table, tokens = self.table, []
        places, choices = [0], []  # where each token starts, and what is left to try there
        dead = set()  # places from which no arc leads on; a place is only ever reached in one state
        while places[-1] < n:
            at = places[-1]
            if len(choices) < len(places):
                node, found = self.spelling, []
                for j in range(at, n):
                    node = node.get(word[j])
                    if node is None:
                        break
                    token = node.get(WORD_END if j + 1 == n else None)
                    if token is not None:
                        found.append((j + 1, token))
                choices.append(found)
            left, found = tokens[-1] if tokens else -1, choices[-1]
            while found:
                end, token = found.pop()  # the longest label first
                if end in dead:
                    continue
                there = True if left < 0 else table.get(left << 32 | token)
                if self.arc(left, token) if there is None else there:
                    places.append(end)
                    tokens.append(token)
                    break
            else:
                if not tokens:
                    raise ValueError(f"no spelling of {word[:40]!r} in this vocabulary")
                dead.add(places.pop())
                choices.pop()
                tokens.pop()
        return tokens


class _Words(dict):
    """Token ids (as bytes of int32) of pre-split words met so far.

    From ``MOST_WORDS`` on a new generation is begun; the words of the last one that are met again
    move over, so frequent words stay.
    """

    def __init__(self, codec: Codec):
        self.codec = codec
        self.last: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MOST_WORDS:
            self.last = dict(self)
            self.clear()
        ids = self.last.get(piece)
        if ids is None:
            symbols = self.codec.symbols
            word = "".join([symbols[b] for b in piece.encode()])
            ids = np.array(self.codec.automaton.encode(word), np.int32).tobytes()
        self[piece] = ids
        return ids


class Codec:
    """Texts to ids and back, for a tokenizer file with NFC, lower case, a split rule and word ends."""

    def __init__(self, shared: str):
        shared = json.loads(shared)
        spec, classes = json.loads(shared["spec"]), shared["classes"]
        model, added = spec["model"], spec["added_tokens"]
        self.automaton = Automaton(model["vocab"], map(tuple, model["merges"]))
        self.special = {t["content"]: t["id"] for t in added}
        self.labels = self.automaton.label | {i: t for t, i in self.special.items()}
        self.label_array = pa.array([self.labels.get(i) for i in range(max(self.labels, default=-1) + 1)], pa.string())
        rule = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        # The file's rule is meant with the Unicode white space property.
        self.pieces = regex.compile(rule.replace(r"\s", r"\p{White_Space}")).findall
        # The same rule with the library's own letters and numbers, for texts where they matter.
        own = rule.replace("[\\p{L}]", f"[{classes['letters']}]").replace("\\p{L}", classes["letters"])
        own = own.replace("\\p{N}", classes["numbers"]).replace(r"\s", r"\p{White_Space}")
        self.own_pieces = regex.compile(own).findall
        self.odd = regex.compile(f"[{classes['odd']}]").search if classes["odd"] else lambda text: None
        self.unsettled = regex.compile(f"[^{SETTLED}]").search
        self._library = None
        # The same rule for texts of Latin-1 characters, for the quicker engine.
        plain = rule.replace("[\\p{L}]", f"[{LATIN_LETTERS}]").replace("\\p{L}", LATIN_LETTERS)
        plain = plain.replace("\\p{N}", LATIN_NUMBERS).replace("\\s", LATIN_SPACE)
        self.plain_pieces = re.compile(plain).findall
        names = "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))
        self.split_special = regex.compile(f"({names})").split if names else lambda text: [text]
        self.symbols = byte_symbols()
        self.words = _Words(self)

    def encode(self, text: str) -> np.ndarray:
        """Token ids of a whole text."""
        out: list[bytes] = []
        for part in self.split_special(text) if "<|" in text else [text]:
            if part in self.special:
                out.append(np.int32(self.special[part]).tobytes())
                continue
            split = self.plain_pieces
            try:
                part.encode("latin-1")  # such texts are in normal form as they are
                part = part.lower()
            except UnicodeEncodeError:
                part, split = self.normal(part), self.own_pieces if self.odd(part) else self.pieces
            out += map(self.words.__getitem__, split(part))
        return np.frombuffer(b"".join(out), np.int32)

    def normal(self, text: str) -> str:
        """Normal form C in lower case, as of the library's Unicode version where that may matter."""
        if not self.unsettled(text):
            # Lower case goes by single characters: no final form of sigma.
            return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        if self._library is None:
            from tokenizers import normalizers

            self._library = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        return self._library.normalize_str(text)

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join(map(self.labels.__getitem__, ids))


def _codec(spec: str) -> Codec:
    """The codec of this Python worker; it outlives the task, with the words it has met."""
    kept = sys.modules.setdefault("_bpe_codec_of_this_worker", types.ModuleType("kept")).__dict__
    if kept.get("spec") != spec:
        kept.update(spec=spec, codec=Codec(spec))
    return kept["codec"]


def _shared_spec(spark: SparkSession, vocabulary: str):
    """The tokenizer file and character classes, read by the driver and sent once to each executor (a few MB)."""
    with open(vocabulary, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(json.dumps({"spec": file.read(), "classes": library_classes()}))


def _mapped(df: DataFrame, source: str, target: str, kind: str, spec, work: Callable) -> DataFrame:
    """``df`` with the column ``target`` (replaced if there) made from ``source`` batch by batch."""
    kept = [c for c in df.columns if c != target]
    schema = df.select(*(F.col(f"`{c}`") for c in kept)).withColumn(target, F.lit(None).cast(kind)).schema
    source = source if source in kept else target

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(spec.value)
        for whole in batches:
            for i in range(0, len(whole), ROWS_AT_ONCE):
                batch = whole.slice(i, ROWS_AT_ONCE)
                made = work(codec, batch.column(batch.schema.get_field_index(source)))
                columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, made], names=[*kept, target])

    return df.mapInArrow(run, schema)


def encode(docs: DataFrame, vocabulary: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """``docs`` with the token ids (array<int>) of whole texts; NULL and empty texts have none.

    All other columns are kept; one named like ``out`` is replaced.
    """

    def work(codec: Codec, texts: pa.Array) -> pa.Array:
        ids = [codec.encode(t.as_py() or "") for t in texts]
        ends = np.cumsum([0, *map(len, ids)])
        flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))

    return _mapped(docs, text, out, "array<int>", _shared_spec(docs.sparkSession, vocabulary), work)


def decode(docs: DataFrame, vocabulary: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the text of token ids: their labels with one space between; NULL gives ''."""

    def work(codec: Codec, rows: pa.Array) -> pa.Array:
        parts = []
        step = max(1, len(rows) * DECODE_TOKENS // max(1, len(rows.flatten())))
        for i in range(0, len(rows), step):
            some = rows.slice(i, step).fill_null([])
            ends = np.cumsum([0, *pc.list_value_length(some).to_numpy(zero_copy_only=False)])
            labels = codec.label_array.take(some.flatten())
            parts.append(pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), labels), " "))
        return pa.chunked_array(parts or [[]], pa.string()).combine_chunks() if len(parts) != 1 else parts[0]

    return _mapped(docs, ids, out, "string", _shared_spec(docs.sparkSession, vocabulary), work)


def token_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id``, ``n_tokens`` and digests of the ids and of the decoded text of every row."""
    both = decode(encode(docs.select("doc_id", "text"), vocabulary).drop("text"), vocabulary)
    return both.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op3_bpe")
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
