"""The registered queries of this package, each over its whole table."""

from __future__ import annotations

import uuid

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import align, chat, language, leaks, packing, personal, quality, ranking, simhash, stock, urls, vectors, wavelet
from shelfwise.llm.common import fold, prepare, shared_folder, staged, table

QUERIES = {}

# The small labelled URL table of the URL filter: 1 is block.
URL_LABELS = [
    ("https://www.spam-site.example.com/en/12", 1), ("http://mail.spam-mail.example.net/offer", 1),
    ("https://link-farm.example.org/de/7", 1), ("http://content-farm.example.com/fr/88", 1),
    ("https://cheap-meds.example.net/en/4", 1), ("http://www.buy-pills.example.org/en/31.html", 1),
    ("https://pills-shop.example.com/es/9", 1), ("http://casino-club.example.org/en/5", 1),
    ("https://www.online-casino.example.com/de/77", 1), ("http://win-money.example.net/en/6", 1),
    ("https://free-money.example.com/en/1", 1), ("http://free-games-bets.example.org/en/2", 1),
    ("https://bets-now.example.net/fr/3", 1), ("https://sport-bets.example.com/en/40", 1),
    ("http://adult-video.example.net/en/8", 1), ("https://www.adult-chat.example.org/en/22", 1),
    ("http://xxx-adult.example.com/es/10", 1), ("https://ads-server.example.net/click/5", 1),
    ("http://click-track.example.com/en/15", 1), ("https://track-ads.example.org/en/60", 1),
    ("http://m.ads-click.example.com/en/9?utm_source=feed", 1), ("https://blog.poker-win.example.net/de/2", 1),
    ("https://www.news-daily.example.com/en/12", 0), ("http://blog.garden.example.org/de/3", 0),
    ("https://university.example.net/fr/45.html", 0), ("https://library.example.org/en/7", 0),
    ("http://m.weather.example.com/es/2", 0), ("https://recipes.example.net/en/99#top", 0),
    ("https://www.museum.example.org/fr/12/", 0), ("http://history.example.com/en/31?page=2&ref=x", 0),
    ("https://science.example.net/de/8", 0), ("http://blog.travel.example.com/es/64", 0),
    ("https://thinking.example.org/en/5", 0), ("https://station.example.net/en/17.html", 0),
    ("http://www.nation.example.com/fr/3", 0), ("https://m.other.example.org/en/52", 0),
    ("https://there.example.net/en/61/", 0), ("http://their-tions.example.com/de/9", 0),
    ("https://blog.earth.example.org/en/70", 0), ("https://m.author.example.com/en/41#top", 0),
    ("http://www.theory.example.net/es/6", 0), ("https://motion.example.org/en/18?utm_source=feed", 0),
    ("http://health.example.com/en/21", 0), ("https://city-council.example.net/fr/29", 0),
]
# The rules are fixed values of the query.
URL_RULES = [
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
    ("allow", "com/fr/"), ("block", "com/de/"),
]


def registered(query):
    QUERIES[query.__name__] = query
    return query


@registered
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; a third of the documents is held out of the training."""
    docs = table(prepare(spark), sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold(F.col("doc_id"), 3) == 1
    model = language.trained_and_calibrated(docs.where(~held_out), F.col("doc_id"))
    return language.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


@registered
def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(prepare(spark), sf_dir, "documents"), width=3, bits=2)


@registered
def op3_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(prepare(spark))}/shelfwise-tokens-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    wavelet.write_shards(docs, public_tokenizers.path("byte_bpe_50k.json"), 0, path)
    return wavelet.read_shards(spark.read.schema(wavelet.SHARDS).parquet(path))


@registered
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    return packing.packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 1, 4096)


@registered
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = prepare(spark).sql(
        "select * from values " + ", ".join(f"('{url}', {label})" for url, label in URL_LABELS) + " as t(url, label)"
    )
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judged(pages, urls.train(labelled), URL_RULES).drop("url")


@registered
def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(prepare(spark), sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.sql(
        "select -1L as conv_id, turn, role, '</s>[INST] ok [/INST]' as text "
        "from values (0L, 'user'), (1L, 'assistant') as t(turn, role)"
    )
    log = chat.turn_events(turns.unionByName(own))
    return chat.digests(staged(chat.rendered(chat.messages(log)), "chats"))


@registered
def op9_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; a fifth of the documents is held out of the training."""
    docs, labels = table(prepare(spark), sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = fold(F.col("doc_id"), 5) == 0
    scored = quality.scored(docs, labels.select("doc_id", "quality"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@registered
def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(prepare(spark), sf_dir, "embeddings"), 0.98)


@registered
def op2_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked(table(prepare(spark), sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@registered
def op11_cutting_stock_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, vocabulary = table(prepare(spark), sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")
    placed = stock.packed_documents(docs, vocabulary, 0, 1024, stock.powers_of_two(1024))
    return placed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@registered
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    docs, items = table(prepare(spark), sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return ranking.ranked(docs, items)


@registered
def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    return align.alignment(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@registered
def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents").select("doc_id", "text")
    found = personal.find(docs, personal.default_model())
    counts = [
        F.regexp_count("base_spans", F.lit(f"{kind}:")).cast("long").alias(f"n_{kind}") for kind in personal.KINDS
    ]
    return found.select("doc_id", *counts, F.sha2("base_spans", 256).alias("base_sha256"), "spans")


@registered
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole corpus pipeline."""
    return corpus_pipeline.run(spark, sf_dir)
