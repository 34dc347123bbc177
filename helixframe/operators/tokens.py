"""Vocabularies and encodings (TOK-03..16, JON-03/04, TOP-03).

Per-row work is Spark expressions.  Two steps need Python: accent stripping
(Unicode NFD has no Spark built-in) and WordPiece longest-match encoding;
both are Arrow UDFs over batches of bounded size, and only the words that need them
become Python objects (accents: words beyond ASCII; encoding: the distinct
words of a batch).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from helixframe.functions.text import BERT_TOKEN, chars, explode_items, pad_truncate
from helixframe.operators.piecetrie import PieceTrie
from helixframe.operators.ranks import running_totals
from helixframe.operators.reshape import position_by
from helixframe.session import Shared, bounded_batches, reliable_checkpoint, scratch_path

# ---- fixed values that must equal the libraries the reference calls ----
# BERT special tokens, ids 0-4 in this order.
BERT_SPECIALS = ["[UNK]", "[PAD]", "[CLS]", "[SEP]", "[MASK]"]
WORDPIECE_PREFIX = "##"
WORDPIECE_MAX_CHARS = 100
# ESM-2 residue alphabet, token ids 0-32 in this order.
ESM_ALPHABET = ["<cls>", "<pad>", "<eos>", "<unk>",
                "L", "A", "G", "V", "S", "E", "R", "T", "I", "D", "P", "K", "Q", "N",
                "F", "Y", "M", "H", "W", "C", "X", "B", "U", "Z", "O", ".", "-",
                "<null_1>", "<mask>"]
# Keras Tokenizer default filters (characters turned into separators).
KERAS_FILTERS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~\t\n'
# Residue order of the 21-wide one-hot residue feature (20 residues, then unknown).
RESIDUE_ORDER = ["G", "A", "S", "P", "V", "T", "C", "I", "L", "N",
                 "D", "Q", "K", "E", "M", "H", "F", "R", "Y", "W"]
# CJK ideograph ranges that BERT's normaliser surrounds with spaces.
CJK_RANGES = [(0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F),
              (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F)]
# ---- end of fixed values ----

CJK_CLASS = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in CJK_RANGES) + "]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---- character vocabulary (TOK-03, TOK-04, JON-03, TOP-03) ----

def fit_char_vocab(df: DataFrame, text: str, order_cols: Sequence[str], lower: bool = True) -> DataFrame:
    """Character vocabulary as Keras ``Tokenizer(char_level=True)`` fits it:
    every character counted, id 1 = most frequent, ties by first appearance
    in ``order_cols`` order then position.  Returns ``(token, id, count)``.

    The first order column is numeric.  The count and its smallest value for
    every character come from one hash aggregate over the exploded characters
    (partial aggregation: the shuffle carries about one row per distinct
    character per task).  The other columns and the position are read in a
    second pass over only the rows with these values.
    """
    t = F.lower(F.col(text)) if lower else F.col(text)
    return _fit_vocab(df, lambda: chars(t), order_cols)


def keras_words(text, lower: bool = True, filters: str = KERAS_FILTERS) -> Column:
    """Keras ``text_to_word_sequence``: lower-case, every filter character
    becomes a space, split on single spaces, empty strings dropped."""
    t = F.lower(_c(text)) if lower else _c(text)
    cls = "[" + "".join({"\t": "\\t", "\n": "\\n"}.get(c, "\\" + c) for c in filters) + "]"
    return F.filter(F.split(F.regexp_replace(t, cls, " "), " "), lambda w: w != "")


def fit_word_vocab(df: DataFrame, text: str, order_cols: Sequence[str], lower: bool = True) -> DataFrame:
    """Word vocabulary as Keras ``Tokenizer()`` fits it (TOK-03 word form):
    id 1 = most frequent word, ties by first appearance.  It stays in Spark
    whatever its size; cap it afterwards with :func:`cap_vocab`
    (``num_words``)."""
    return _fit_vocab(df, lambda: keras_words(F.col(text), lower), order_cols)


def _fit_vocab(df: DataFrame, tokens, order_cols: Sequence[str]) -> DataFrame:
    first, others = order_cols[0], list(order_cols[1:])
    if not isinstance(df.schema[first].dataType, NumericType):
        raise ValueError(f"the first order column must be numeric: {first}")
    ex = explode_items(df, tokens(), "token", keep=[first])
    # one row per distinct token, written once: read for the second pass, its join and the numbering
    agg = reliable_checkpoint(ex.groupBy("token").agg(F.count(F.lit(1)).alias("count"), F.min(first).alias(first)))
    sub = df.join(agg.select(first).distinct(), first, "left_semi")
    firsts = explode_items(sub, tokens(), "token", keep=list(order_cols), with_pos="pos")
    place = (firsts.join(agg.select("token", first), ["token", first])
             .groupBy("token").agg(F.min(F.struct(*others, "pos")).alias("_first")))
    counts = agg.join(place, "token").withColumn("_major", -F.col("count"))
    # most frequent first: the tokens of one count are numbered by ranges of their first row
    ranked = position_by(counts, "_major", [first, "_first"], out="_rank")
    return ranked.select("token", (F.col("_rank") + 1).cast("int").alias("id"), "count")


def cap_vocab(vocab: DataFrame, num_words: int) -> DataFrame:
    """Keep ids below ``num_words`` (Keras ``num_words``, TOP-03)."""
    return vocab.where(F.col("id") < num_words)


PAGE = 256


def vocab_map(vocab: DataFrame, key: str = "token", value: str = "id") -> Column:
    """A character vocabulary as a literal table by code point: an array of
    pages of 256 ids, so a lookup costs the same at any vocabulary size.  (A
    literal map would be searched entry by entry.)  A vocabulary of single
    characters holds at most all of Unicode, which bounds what comes to the
    driver; tokens of several characters must be joined."""
    pages: dict[int, dict[int, int]] = {}
    for token, i in vocab.select(key, value).collect():
        if len(token) != 1:
            raise ValueError(f"not a single character: {token!r}; use encode_chars_by_join")
        pages.setdefault(ord(token) // PAGE, {})[ord(token) % PAGE] = i
    none = F.lit(None).cast("array<int>")
    return F.array(*[F.array(*[F.lit(pages[p].get(k)).cast("int") for k in range(PAGE)]) if p in pages else none
                     for p in range(max(pages, default=0) + 1)])


def encode_chars(text, mapping: Column, lower: bool = True, keep_unknown: int | None = None) -> Column:
    """Characters to ids through ``mapping`` (:func:`vocab_map`; TOK-04 /
    JON-03).  Unknown characters are dropped (Keras) or mapped to
    ``keep_unknown``."""
    t = F.lower(_c(text)) if lower else _c(text)

    def find(ch):
        code = F.ascii(ch)                      # the code point
        return F.get(F.get(mapping, F.floor(code / PAGE).cast("int")), code % PAGE)
    ids = F.transform(chars(t), find)
    if keep_unknown is None:
        return F.filter(ids, lambda x: x.isNotNull())
    return F.transform(ids, lambda x: F.coalesce(x, F.lit(keep_unknown)))


def encode_chars_by_join(df: DataFrame, key: str, text: str, vocab: DataFrame, lower: bool = True,
                         out: str = "ids") -> DataFrame:
    """Characters to ids by a join (JON-03): explode ``(key, pos, char)``,
    join the vocabulary (the planner broadcasts it where it is small), and
    rebuild each row's ids in position order.  A group is one row's
    characters, so its size is bounded by the row, not by the table.  Unknown
    characters are dropped; rows with none known get an empty array."""
    t = F.lower(F.col(text)) if lower else F.col(text)
    ex = explode_items(df.select(key, t.alias("_t")), chars(F.col("_t")), "token", keep=[key], with_pos="pos")
    hits = ex.join(vocab.select("token", F.col("id").cast("int").alias("id")), "token")
    per_row = hits.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("_p"))
    encoded = per_row.select(key, F.transform("_p", lambda x: x["id"]).alias(out))
    return (df.select(key).join(encoded, key, "left")
            .withColumn(out, F.coalesce(F.col(out), F.array().cast("array<int>"))))


# ---- lengths (TOK-06, TOK-07) ----

def longest(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Longest string over several columns (TOK-06)."""
    return df.select(F.greatest(*[F.max(F.char_length(c)) for c in cols]).cast("long").alias("max_len"))


def exact_median(df: DataFrame, col: str, out: str = "median") -> DataFrame:
    """Exact median of a column (mean of the middle two for an even count).

    Values are counted first (lengths have few distinct values), running
    counts come from the bucketed helper, and the middle positions are read
    off that small table: no task ever holds all values, unlike
    ``percentile``/``median`` which buffer a whole group.
    """
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    cum = reliable_checkpoint(running_totals(counts, col, ["_n"]))
    n = cum.select(F.sum("_n")).scalar()
    lo = F.floor((n - 1) / 2)
    hi = F.floor(n / 2)
    return cum.agg(((F.min(F.when(F.col("cum__n") > lo, F.col(col))) +
                     F.min(F.when(F.col("cum__n") > hi, F.col(col)))) / 2.0).alias(out))


def median_length(df: DataFrame, text: str, out: str = "model_max_length") -> DataFrame:
    """Integer part of the median character length (TOK-07); the caller
    decides whether it is a character or a token limit."""
    d = df.select(F.char_length(text).alias("_len"))
    return exact_median(d, "_len", "_m").select(F.floor("_m").cast("int").alias(out))


# ---- BERT normalisation and pre-tokenisation (TOK-08) ----

def _strip_marks(text: str) -> str:
    """NFD without non-spacing marks."""
    import unicodedata
    return "".join([c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn"])


def _strip_accents_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    import pyarrow.compute as pc
    for texts in batches:
        odd = pc.fill_null(pc.invert(pc.string_is_ascii(texts)), False)
        stripped = [_strip_marks(x.as_py()) for x in texts.filter(odd)]
        yield pc.replace_with_mask(texts, odd, pa.array(stripped, texts.type)) if stripped else texts


def strip_accents(col) -> Column:
    """NFD + drop non-spacing marks (Arrow UDF).  Only texts beyond ASCII
    become Python objects, one at a time; :func:`bounded_batches` keeps the
    batches of whole texts small."""
    bounded_batches(SparkSession.active())
    return F.arrow_udf(_strip_accents_batches, "string")(_c(col))


def bert_clean_lower(col, lowercase: bool = True, clean: bool = True, cjk: bool = True) -> Column:
    """BertNormalizer without the accent step: drop control characters, map
    whitespace (tab, newline, return, and the separators Zs, Zl and Zp) to
    spaces, put spaces around CJK ideographs, lower-case.  All JVM."""
    s = _c(col)
    if clean:
        s = F.regexp_replace(s, r"[\x{0}\x{FFFD}]|[^\P{C}\t\n\r]", "")
        s = F.regexp_replace(s, r"[\t\n\r\p{Z}]", " ")
    if cjk:
        s = F.regexp_replace(s, f"({CJK_CLASS})", " $1 ")  # handle_chinese_chars
    return F.lower(s) if lowercase else s


def bert_normalize(col, lowercase: bool = True, accents: bool | None = None) -> Column:
    """BertNormalizer: drop control characters, map whitespace to spaces,
    lower-case and strip accents (by default when lower-casing)."""
    s = bert_clean_lower(col, lowercase)
    if accents is None:
        accents = lowercase
    return strip_accents(s) if accents else s


def bert_pretokenize(col) -> Column:
    """BertPreTokenizer: split on spaces, every punctuation mark a token
    (run after the normaliser, which has turned all whitespace into spaces)."""
    return F.regexp_extract_all(_c(col), F.lit(BERT_TOKEN), 0)


def bert_raw_words(col) -> Column:
    """Pre-tokenized words before accent stripping (JVM only).  Stripping is
    per character, so it can be applied later to distinct words, followed
    by a second split (:func:`strip_word_counts`, :func:`wordpiece_ids`)."""
    return bert_pretokenize(bert_clean_lower(col))


def strip_word_counts(counts: DataFrame, word: str = "word", count: str = "count") -> DataFrame:
    """Accent-strip a ``(word, count)`` table of raw words and split again:
    the Python step sees each distinct word once, not every occurrence."""
    stripped = counts.select(strip_accents(F.col(word)).alias("_s"), F.col(count))
    again = stripped.select(F.explode(bert_pretokenize(F.col("_s"))).alias(word), count)
    return again.groupBy(word).agg(F.sum(count).cast("long").alias(count))


# ---- WordPiece training (TOK-09) ----

def _initial_symbols(word: Column) -> Column:
    cs = chars(word)
    return F.transform(cs, lambda ch, i: F.when(i == 0, ch).otherwise(F.concat(F.lit(WORDPIECE_PREFIX), ch)))


def _adjacent(sym: str) -> Column:
    """The adjacent pairs of a symbol array, as an array of (l, r)."""
    n = F.size(sym)
    pairs = F.arrays_zip(F.slice(sym, 1, n - 1).alias("l"), F.slice(sym, 2, n - 1).alias("r"))
    return F.when(n > 1, pairs).otherwise(F.array().cast("array<struct<l:string,r:string>>"))


class PairIndex:
    """Pairs -> the words that hold them, and how often each pair occurs.

    A row of the index is a pair with a word that holds it, complete with the
    word's symbols, its count and the round ``gen`` it is from; a word that a
    merge changes is written again under every pair that it held or holds now,
    so the latest row of a word under any pair is the word as it is.  The index
    lies in files sorted by pair: a round reads the rows of the pairs it
    merges (the file statistics leave out the rest) and the words changed
    since the last files were written, not the word table.  ``rows_read``
    has the index rows that each round read.
    """

    INDEX = "l string, r string, wid long, gen int, count long, sym array<string>"

    def __init__(self, state: DataFrame, segment_every: int):
        self.spark, self.every = state.sparkSession, segment_every
        self.folder, self.gen, self.segment = scratch_path(self.spark, "wordpiece-index"), 0, 0
        state = state.withColumn("gen", F.lit(0))
        self._write(state.select(F.explode(F.array_distinct(_adjacent("sym"))).alias("p"), "wid", "gen", "count", "sym"))
        self.counts = reliable_checkpoint(self._sums(state, "sym", 1))
        self.changes: list[DataFrame] = []
        self.deltas: list[DataFrame] = []
        self.gone: dict[tuple[str, str], int] = {}      # merged without a look at the words: rows up to this round are past
        self.rows_read: list[int] = []

    def _write(self, entries: DataFrame) -> None:
        (entries.select("p.l", "p.r", "wid", "gen", "count", "sym").repartitionByRange("l", "r").sortWithinPartitions("l", "r")
         .write.parquet(f"{self.folder}/segment={self.segment}"))
        self.segment += 1

    @staticmethod
    def _sums(words: DataFrame, sym: str, sign: int) -> DataFrame:
        """(l, r, c, c_long): occurrences of each pair, and those in words of
        more than two symbols."""
        n = F.col("count") * sign
        return (words.select(F.explode(_adjacent(sym)).alias("p"), n.alias("n"), F.when(F.size(sym) > 2, n).otherwise(0).alias("m"))
                .groupBy("p.l", "p.r").agg(F.sum("n").alias("c"), F.sum("m").alias("c_long")))

    def totals(self) -> DataFrame:
        """(l, r, c, c_long) of all pairs as they are now."""
        if not self.deltas:
            return self.counts
        every = self.counts
        for d in self.deltas:
            every = every.unionByName(d)
        return every.groupBy("l", "r").agg(F.sum("c").alias("c"), F.sum("c_long").alias("c_long")).where("c > 0")

    def _entries(self, changed: DataFrame) -> DataFrame:
        pairs = F.array_distinct(F.concat(_adjacent("old"), _adjacent("sym")))
        return changed.select(F.explode(pairs).alias("p"), "wid", "gen", "count", "sym")

    def merge(self, isolated: list[tuple], general: list[tuple]) -> None:
        """Apply merges (l, r, made).  ``isolated`` pairs occur in words of two
        symbols only and with the count given in place of ``made``: no other
        pair changes, so no word is read."""
        self.gen += 1
        if isolated:
            self.gone.update({(l, r): self.gen - 1 for l, r, _ in isolated})
            self.deltas.append(self.spark.createDataFrame([(l, r, -c, 0) for l, r, c in isolated], "l string, r string, c long, c_long long"))
        if general:
            wanted = F.broadcast(self.spark.createDataFrame(
                [(l, r, self.gone.get((l, r), -1)) for l, r, _ in general], "l string, r string, __after int"))
            index = self.spark.read.schema(self.INDEX).parquet(f"{self.folder}/segment=*")
            rows = index.where(F.col("l").isin([l for l, _, _ in general]) & F.col("r").isin([r for _, r, _ in general]))
            for c in self.changes:
                rows = rows.unionByName(self._entries(c).select("p.l", "p.r", "wid", "gen", "count", "sym"))
            read = Observation()
            rows = rows.join(wanted, ["l", "r"]).where("gen > __after").observe(read, F.count(F.lit(1)).alias("n"))
            now = rows.groupBy("wid").agg(F.max_by(F.struct("count", "sym"), "gen").alias("w"))
            old = now.select("wid", F.lit(self.gen).alias("gen"), "w.count", F.col("w.sym").alias("old"), "w.sym")
            changed = _apply_merges(old, general).where(F.size("sym") < F.size("old"))
            path = scratch_path(self.spark, "wordpiece-changes")
            changed.write.parquet(path)
            changed = self.spark.read.schema(changed.schema).parquet(path)
            self.changes.append(changed)
            self.deltas += [self._sums(changed, "old", -1), self._sums(changed, "sym", 1)]
            self.rows_read.append(read.get["n"])
        if self.gen % self.every == 0:
            for c in self.changes:
                self._write(self._entries(c))
            self.counts = reliable_checkpoint(self.totals())
            self.changes, self.deltas = [], []


def train_wordpiece(words: DataFrame, word: str = "word", count: str = "count",
                    vocab_size: int = 30000, min_frequency: int = 0,
                    specials: Sequence[str] = BERT_SPECIALS, candidates: int = 4096,
                    segment_every: int = 8, spark: SparkSession | None = None,
                    rows_read: list[int] | None = None) -> DataFrame:
    """Train a WordPiece vocabulary from ``(word, count)`` (TOK-09).

    Ids: the special tokens, then the alphabet (word-initial characters
    sorted, then ``##`` characters sorted), then merged tokens in merge order.
    Each merge takes the most frequent adjacent pair, ties by (left, right)
    ascending.  Pair counts and an index from pairs to words are kept up to
    date (:class:`PairIndex`), so a round touches only words that hold a merged
    pair.  Each round sends the most frequent pairs (at most ``candidates``) to
    the driver and applies several of them, as long as that equals one merge
    per round:

    * a pair that only occurs in two-symbol words touches no other pair;
    * after another pair (l, r) the next one must not begin with r or end with
      l, else its count may have changed, and must be more frequent than any
      pair that the merge can make: (x, l) and (r, y) bound those.

    ``rows_read`` gets the number of index rows that each round with such
    other pairs read.
    """
    spark = spark or words.sparkSession
    state = (words.groupBy(word).agg(F.sum(count).cast("long").alias("count"))
             .select(_initial_symbols(F.col(word)).alias("sym"), "count")
             .where(F.size("sym") > 0).withColumn("wid", F.monotonically_increasing_id()))
    state = reliable_checkpoint(state)
    alpha = state.select(F.explode("sym").alias("t")).distinct()
    heads = sorted(r[0] for r in alpha.where(~F.col("t").startswith(WORDPIECE_PREFIX)).collect())
    tails = sorted(r[0] for r in alpha.where(F.col("t").startswith(WORDPIECE_PREFIX)).collect())
    vocab: list[str] = list(dict.fromkeys([*specials, *heads, *tails]))
    known = set(vocab)
    index = PairIndex(state, segment_every)
    while len(vocab) < vocab_size:
        ranked = (index.totals().where(F.col("c") >= max(min_frequency, 1))
                  .orderBy(F.col("c").desc(), "l", "r").limit(candidates).collect())
        if not ranked:
            break
        isolated: list[tuple[str, str, int]] = []
        general: list[tuple[str, str, str]] = []
        rest = ranked[-1]["c"] if len(ranked) == candidates else 0      # no other pair is more frequent
        ends: dict[str, int] = {}
        begins: dict[str, int] = {}
        for row in ranked:
            ends.setdefault(row["r"], row["c"])
            begins.setdefault(row["l"], row["c"])
        made = 0                                                        # no pair made in this round is more frequent
        for row in ranked:
            lft, rgt = row["l"], row["r"]
            if len(vocab) >= vocab_size or (general and row["c"] <= made):
                break
            if row["c_long"] and any(lft == r or rgt == l for l, r, _ in general):
                break
            new = lft + rgt[len(WORDPIECE_PREFIX):] if rgt.startswith(WORDPIECE_PREFIX) else lft + rgt
            seen = new in known
            if not seen:
                vocab.append(new)
                known.add(new)
            if not row["c_long"]:
                isolated.append((lft, rgt, row["c"]))
                continue
            general.append((lft, rgt, new))
            made = max(made, min(row["c"], max(ends.get(lft, rest), begins.get(rgt, rest), rest)))
            if seen:                            # its other occurrences may gain from this merge
                break
        index.merge(isolated, general)
    if rows_read is not None:
        rows_read += index.rows_read
    return spark.createDataFrame([(t, i) for i, t in enumerate(vocab)], "token string, id int")


def _apply_merges(state: DataFrame, merges) -> DataFrame:
    """``sym`` with every merge (l, r, made) applied from the left."""
    made = F.create_map(*[F.lit(x) for l, r, n in merges for x in (l + "\u0000" + r, n)])
    init = F.array().cast("array<string>")

    def step(acc, s):
        hit = made[F.concat(F.try_element_at(acc, F.lit(-1)), F.lit("\u0000"), s)]
        return F.when((F.size(acc) > 0) & hit.isNotNull(), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(hit))) \
                .otherwise(F.concat(acc, F.array(s)))
    return state.withColumn("sym", F.aggregate("sym", init, step))


# ---- WordPiece encoding (TOK-10) ----

def _split_words(text: str) -> list[str]:
    """:func:`bert_pretokenize` of one stripped word: every punctuation mark
    (ASCII 33-47, 58-64, 91-96, 123-126 and Unicode class P) is a token."""
    import unicodedata
    out, run = [], ""
    for c in text:
        mark = 33 <= ord(c) <= 126 and not c.isalnum() or unicodedata.category(c).startswith("P")
        if mark or c == " ":
            out += [run] if run else []
            out += [c] if mark else []
            run = ""
        else:
            run += c
    return [*out, run] if run else out


#: stands before a word that is a special token; normalised words hold no private characters
SPECIAL_MARK = "\ue000"
#: words of which a task keeps the pieces
CACHE_WORDS = 200_000


def wordpiece_ids(words_col, vocab: DataFrame, unk_token: str = "[UNK]", strip: bool = True,
                  max_entries: int = 1_000_000, prefix: str = WORDPIECE_PREFIX,
                  max_chars: int = WORDPIECE_MAX_CHARS, specials: dict[str, int] | None = None) -> Column:
    """Encode an array of pre-tokenized words to WordPiece ids (TOK-10):
    longest match first, ``##`` continuations, ``[UNK]`` for a word that
    cannot be covered or is longer than 100 characters.

    With ``strip`` the words are raw (:func:`bert_raw_words`): each is
    accent-stripped and split again here, which equals stripping the text
    first.  The vocabulary, of ``max_entries`` at most, is broadcast as a trie
    that reads a word in one pass (:class:`PieceTrie`); a task keeps the words
    it has encoded over all its batches, so each distinct word is cut into
    pieces once per task.  A word that begins with ``SPECIAL_MARK`` is a
    special token, with its id in ``specials``.
    """
    rows = vocab.select("token", "id").limit(max_entries + 1).collect()
    if len(rows) > max_entries:
        raise ValueError(f"a vocabulary of more than {max_entries} pieces is not sent to the tasks")
    ids_of = {r[0]: int(r[1]) for r in rows}
    bc = Shared(vocab.sparkSession, PieceTrie(ids_of, ids_of[unk_token], prefix, max_chars))
    marked = {SPECIAL_MARK + t: [i] for t, i in (specials or {}).items()}

    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np
        import pyarrow.compute as pc
        trie, cache = bc.value, dict(marked)

        def word_ids(w: str) -> list[int]:
            if (ids := cache.get(w)) is None:
                if len(cache) >= CACHE_WORDS:
                    cache.clear()
                    cache.update(marked)
                pieces = [w] if not strip else _split_words(w if w.isascii() else _strip_marks(w))
                ids = cache[w] = [i for p in pieces for i in trie.encode(p)]
            return ids

        for batch in batches:
            words = batch.flatten().dictionary_encode("encode")
            of = [word_ids(w) for w in words.dictionary.to_pylist()]
            size = np.fromiter(map(len, of), "i8", len(of))
            pool, start = np.fromiter((i for ids in of for i in ids), "i4", int(size.sum())), np.cumsum(size) - size
            at = words.indices.to_numpy(zero_copy_only=False)
            n, end = size[at], np.cumsum(size[at])              # the words' ids, one word after another
            ids = pool[np.arange(end[-1] if len(end) else 0) + np.repeat(start[at] - end + n, n)]
            stop = np.cumsum(pc.fill_null(batch.value_lengths(), 0).to_numpy(zero_copy_only=False))
            ends = np.concatenate([[0], np.concatenate([[0], end])[stop]]).astype("i4")
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(ids), mask=batch.is_null())

    bounded_batches(vocab.sparkSession)
    return F.arrow_udf(encode, "array<int>")(_c(words_col))


# ---- padding for models (TOK-11..16) ----

def pad_left_truncate_right(ids, length, pad_id: int) -> tuple[Column, Column]:
    """Truncate on the right to ``length`` and pad on the left with
    ``pad_id`` (TOK-11).  ``length`` may be a column (longest in batch).
    Returns ``(input_ids, attention_mask)``."""
    ids = _c(ids)
    L = length if isinstance(length, Column) else F.lit(length)
    cut = F.slice(ids, 1, L) if not isinstance(length, Column) else F.slice(ids, F.lit(1), L)
    n = F.size(cut)
    pad = F.greatest(L - n, F.lit(0))
    return (F.concat(F.array_repeat(F.lit(pad_id), pad), cut),
            F.concat(F.array_repeat(F.lit(0), pad), F.array_repeat(F.lit(1), n)))


def residue_ids(seq, alphabet: Sequence[str] = ESM_ALPHABET, unk: str = "<unk>",
                bos: str | None = "<cls>", eos: str | None = "<eos>") -> Column:
    """Residues to ids by a literal alphabet table, unknown -> ``unk``, with
    begin and end markers (TOK-12, JON-04)."""
    ids = {t: i for i, t in enumerate(alphabet)}
    m = F.create_map(*[F.lit(x) for t, i in ids.items() for x in (t, i)])
    body = F.transform(chars(seq), lambda ch: F.coalesce(m[ch], F.lit(ids[unk])))
    parts = []
    if bos:
        parts.append(F.array(F.lit(ids[bos])))
    parts.append(body)
    if eos:
        parts.append(F.array(F.lit(ids[eos])))
    return F.concat(*parts)


def baseline_ids(input_ids, cls_id: int = 0, pad_id: int = 1, eos_id: int = 2) -> Column:
    """Attribution baseline: begin marker, padding for the inside, end marker
    (TOK-13)."""
    n = F.size(_c(input_ids))
    return F.concat(F.array(F.lit(cls_id)), F.array_repeat(F.lit(pad_id), F.greatest(n - 2, F.lit(0))),
                    F.array(F.lit(eos_id)))


def drop_markers(per_position, n_markers_front: int = 1, n_markers_back: int = 1) -> Column:
    """Remove begin/end marker positions from a per-position array (TOK-14)."""
    a = _c(per_position)
    keep = F.greatest(F.size(a) - n_markers_front - n_markers_back, F.lit(0))
    return F.slice(a, n_markers_front + 1, keep)


def ids_to_tokens(ids, alphabet: Sequence[str] = ESM_ALPHABET) -> Column:
    """Ids back to tokens with the inverse table (TOK-15)."""
    inv = F.create_map(*[F.lit(x) for i, t in enumerate(alphabet) for x in (i, t)])
    return F.transform(_c(ids), lambda i: inv[i])


def one_hot(seq, order: Sequence[str] = RESIDUE_ORDER, digits: bool = False) -> Column:
    """Per-residue one-hot rows, ``len(order) + 1`` wide (last = unknown)
    (TOK-16).  The rows are ready literals, found by the code point of the
    character, so a character costs one look-up whatever the width.  With
    ``digits`` a row is the string of its 0s and 1s instead of an array, so
    text made of the rows costs no more than the look-ups."""
    wide = len(order) + 1
    row = [[int(i == k) for i in range(wide)] for k in range(wide)]
    rows = F.array(*[F.lit("".join(map(str, r))) if digits else F.array(*map(F.lit, r)) for r in row])
    place = {ord(a): k for k, a in enumerate(order)}
    at = F.array(*[F.lit(place.get(c, wide - 1)) for c in range(max(place, default=-1) + 1)])
    return F.transform(chars(seq), lambda ch: F.get(rows, F.coalesce(F.get(at, F.ascii(ch)), F.lit(wide - 1))))


def residue_counts(seq, order: Sequence[str] = RESIDUE_ORDER) -> Column:
    """Summed one-hot: count of each residue type, unknown last (TOK-16).
    Each count is ``length - length(without that residue)``: native string
    scans, no per-character lambdas."""
    s = _c(seq)
    n = F.char_length(s)
    known = [n - F.char_length(F.replace(s, F.lit(a), F.lit(""))) for a in order]
    unknown = n - sum(known[1:], known[0])
    return F.array(*known, unknown)


__all__ = [n for n in dir() if not n.startswith("_")] + ["pad_truncate"]
