"""Token ids of a whole corpus by a public byte-level vocabulary, through a table of distinct words.

Texts are split into words in the JVM by the vocabulary's own pattern; a word never shares a token with its neighbour, so
every distinct word is encoded once, whatever its frequency. The ids go back to the texts by position. The HOT most frequent
short words are looked up in a broadcast table of bounded size where a text is read: nearly all words are among them, and a
text that has no other goes no further. The other words of a text are joined with the word table by shuffle, as (text,
position, word), and meet the text's own list again, in which their places are open; a text's list is one array, so neither
the position nor the number of ids of a word has a limit.

The vocabulary's file is read on the driver and travels with the tasks. Null and empty texts have the empty list. Strings
that look like special tokens are ordinary text. Repeated rows (same doc_id and text) come out once; a doc_id with two
texts comes out twice. Decoding joins ids with the pieces of the vocabulary (fixed size) and restores the text exactly.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from outcomelens.session import cut

FOLDER = "/opt/tokenizers"
#: Fixed value: the pattern of the vocabulary; (?U) gives \s and \S their Unicode meaning in Java.
PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
HOT, HOT_CHARS = 20_000, 32


@lru_cache(maxsize=2)
def _tokenizer(definition: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(definition)
    tokenizer.encode_special_tokens = True
    return tokenizer


def _encoder(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(shared.value)
        for batch in batches:
            ids = [e.ids for e in tokenizer.encode_batch(batch.column("word").to_pylist(), add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(ids, pa.list_(pa.int32()))], ["word", "n", "ids"])

    return encode


def split() -> Column:
    """The words of a text."""
    return F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))


def pieces(docs: DataFrame) -> DataFrame:
    """(doc_id, version, pos, word) of every text that is not empty."""
    return docs.where("text is not null and text <> ''").select("doc_id", F.xxhash64("text").alias("version"), F.posexplode(split()).alias("pos", "word"))


def word_table(docs: DataFrame, folder: str = FOLDER) -> DataFrame:
    """(word, n, ids): every distinct word of the corpus, its frequency and its ids."""
    with open(f"{folder}/byte_bpe_50k.json", encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    counted = pieces(docs).groupBy("word").agg(F.count("*").alias("n"))
    return counted.mapInArrow(_encoder(shared), "word string, n bigint, ids array<int>")


def _lists(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, version, words) as (doc_id, version, ids, ends, open, words): the ids of the known words, where those of each word
    end, the positions of the other words, and these words."""

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, starts, ids = shared.value
        known, widths = pa.array(words, pa.string()), np.append(np.diff(starts), 0)  # -1: none
        for batch in batches:
            texts = batch.column("words")
            flat = texts.flatten()
            of_text = np.concatenate([[0], np.cumsum(texts.value_lengths().fill_null(0).to_numpy())])
            at = pc.index_in(flat, value_set=known).fill_null(-1).to_numpy()
            many = np.where(at >= 0, widths[at], 0)
            ends = np.cumsum(many)
            rows = np.repeat(starts[at] - ends + many, many) + np.arange(many.sum())
            of_ids = np.concatenate([[0], ends])[of_text]
            missing = np.flatnonzero(at < 0)
            of_missing = np.searchsorted(missing, of_text)
            owner = np.searchsorted(of_text, missing, side="right") - 1
            base = np.repeat(of_ids[:-1], np.diff(of_text))
            complete = np.diff(of_missing) == 0
            # a text without open places needs no ends
            shown = np.repeat(~complete, np.diff(of_text))
            of_ends = np.concatenate([[0], np.cumsum(np.where(complete, 0, np.diff(of_text)))])
            lists = lambda offsets, values: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
            columns = [
                batch.column("doc_id"), batch.column("version"), lists(of_ids, pa.array(ids[rows], pa.int32())),
                lists(of_ends, pa.array((ends - base)[shown], pa.int32())), lists(of_missing, pa.array(missing - of_text[owner], pa.int32())), lists(of_missing, flat.take(pa.array(missing))),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "version", "ids", "ends", "open", "words"])

    return look_up


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lists with the ids of the other words (found: position and ids) in their places."""
    for batch in batches:
        whole = []
        for ids, ends, found in zip(*(batch.column(name).to_pylist() for name in ("ids", "ends", "found"))):
            out, done = [], 0
            for place in sorted(found, key=lambda f: f["pos"]):
                until = ends[place["pos"]]
                out += ids[done:until]
                out += place["ids"]
                done = until
            whole.append(out + ids[done:])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(whole, pa.list_(pa.int32()))], ["doc_id", "ids"])


def encode(docs: DataFrame, folder: str = FOLDER) -> DataFrame:
    """(doc_id, ids) of (doc_id, text)."""
    words = cut(word_table(docs, folder))
    hot = words.where(F.length("word") <= HOT_CHARS).orderBy(F.desc("n"), "word").limit(HOT).toArrow()  # bounded by HOT
    lists = hot.column("ids").combine_chunks()
    starts = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    shared = docs.sparkSession.sparkContext.broadcast((hot.column("word").to_pylist(), starts, lists.flatten().to_numpy()))
    texts = docs.where("text is not null and text <> ''").select("doc_id", F.xxhash64("text").alias("version"), split().alias("words"))
    schema = "doc_id bigint, version bigint, ids array<int>, ends array<int>, open array<int>, words array<string>"
    read = cut(texts.mapInArrow(_lists(shared), schema))
    # rows of the same text: the first of each is enough, and one that stands alone is not shuffled with its ids
    # (written, so that its size is known before the join is planned)
    again = cut(read.groupBy("doc_id", "version").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "version"))
    once = read.join(again, ["doc_id", "version"], "left_anti").unionByName(read.join(again, ["doc_id", "version"]).dropDuplicates(["doc_id", "version"]))
    rest = once.where(F.size("open") > 0)
    places = rest.select("doc_id", "version", F.explode(F.arrays_zip("open", "words")).alias("p")).select("doc_id", "version", F.col("p.open").alias("pos"), F.col("p.words").alias("word"))
    found = places.join(words.select("word", F.col("ids").alias("w")), "word").groupBy("doc_id", "version").agg(F.collect_list(F.struct("pos", F.col("w").alias("ids"))).alias("found"))
    filled = rest.select("doc_id", "version", "ids", "ends").join(found, ["doc_id", "version"]).select("doc_id", "ids", "ends", "found").mapInArrow(_filled, "doc_id bigint, ids array<int>")
    empty = docs.where("text is null or text = ''").select("doc_id").distinct().select("doc_id", F.array().cast("array<int>").alias("ids"))
    return once.where(F.size("open") == 0).select("doc_id", "ids").unionByName(filled).unionByName(empty)


def vocabulary(spark: SparkSession, folder: str = FOLDER) -> DataFrame:
    """(id, piece as hexadecimal bytes) of the fixed vocabulary."""
    with open(f"{folder}/byte_bpe_50k.tiktoken", "rb") as lines:
        rows = [(int(rank), base64.b64decode(piece).hex()) for piece, rank in (line.split() for line in lines if line.strip())]
    return spark.createDataFrame(rows, "id int, piece string")


def decode(encoded: DataFrame, folder: str = FOLDER) -> DataFrame:
    """(doc_id, text) of (doc_id, ids) by an id-to-piece join; an empty text for an empty list."""
    flat = encoded.select("doc_id", F.posexplode("ids").alias("pos", "id"))
    joined = flat.join(F.broadcast(vocabulary(encoded.sparkSession, folder)), "id")
    spelled = joined.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("p"))
    text = F.decode(F.unhex(F.array_join(F.transform("p", lambda x: x["piece"]), "")), "UTF-8")
    return spelled.select("doc_id", text.alias("text")).unionByName(encoded.where("size(ids) = 0").select("doc_id", F.lit("").alias("text")))
