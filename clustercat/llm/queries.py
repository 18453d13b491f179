"""One query per operator over the driver's tables, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clustercat.llm.alignment import link_counts
from clustercat.llm.chat import format_chat, read_back
from clustercat.llm.decontamination import find_contamination
from clustercat.llm.exact_dedup import exact_groups
from clustercat.llm.language import identify
from clustercat.llm.mixing import mix, taken_words
from clustercat.llm.neighbours import nearest_neighbours
from clustercat.llm.packing import pack
from clustercat.llm.pseudonyms import pseudonymise_documents
from clustercat.llm.quality import judge
from clustercat.llm.repair import repair, repaired_digest
from clustercat.llm.simhash import hex_fingerprint, simhash_groups
from clustercat.llm.warc import archive_pages, page_records
from clustercat.storage import keep

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLE[name] = sql
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_simhash_near_dedup")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """SimHash groups of all documents: three-word shingles, at most three differing bits."""
    groups = simhash_groups(table(spark, folder, "documents"), width=3, distance=3)
    return groups.select(F.col("id").alias("doc_id"), hex_fingerprint().alias("fingerprint"), "component_id")


@query("op2_language_id")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Language of all documents and all pages."""
    return identify(table(spark, folder, "documents"), table(spark, folder, "pages"))


def word_vocabulary() -> str:
    """Path of the vocabulary file that the packing query uses."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op3_best_fit_packing")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack(table(spark, folder, "documents"), word_vocabulary(), capacity=2048).withColumnRenamed("id", "doc_id")


@query(
    "op4_exact_dedup",
    r"""
    with texts as (
      select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents)
    select doc_id, min(doc_id) over (partition by norm) as keep_id, count(*) over (partition by norm) as group_size,
           doc_id = min(doc_id) over (partition by norm) as kept, sha256(norm) as text_sha256
    from texts""",
)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Exact duplicates among all documents, dropped rows included."""
    groups = exact_groups(table(spark, folder, "documents"))
    return groups.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")
    )


@query("op5_quality_classifier")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Posteriors of low quality and toxicity of all documents, and whether each stays."""
    judged = judge(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return judged.select(F.col("id").alias("doc_id"), "low", "toxic", "kept")


CONTROL_TURN = "</s>[INST] ok [/INST]"


@query(
    "op6_chat_formatting",
    r"""
    with turns as (
      select conv_id, turn, role, coalesce(text, '') as text from conversations
      union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
      union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
    written as (
      select *, row_number() over w as place, lag(role) over w as before, regexp_replace(regexp_replace(replace(text, '\', '\\'), '<(/?s>)', '<\\\1', 'g'),
                               '\[(/?(SYS|INST|ROLE|TURN)\])', '[\\\1', 'g') as escaped
      from turns window w as (partition by conv_id order by turn)),
    grouped as (
      select conv_id, count(*) as n_turns,
             string_agg(role || chr(10) || text || chr(10), '' order by turn) as all_text,
             coalesce(string_agg(text, '' order by turn) filter (role = 'assistant'), '') as loss_text,
             sum(length(escaped) + case role when 'system' then 16 when 'user' then 18 else 6 end) as written_chars,
             count(*) filter (not case when place = 1 then role in ('system', 'user') when before = 'user' then role = 'assistant'
                              else role = 'user' end) as errors
      from written group by conv_id)
    select conv_id, n_turns, sha256(all_text) as turns_sha256, length(loss_text) as loss_chars,
           sha256(loss_text) as loss_sha256, cast(written_chars as bigint) as formatted_chars, errors
    from grouped""",
)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations and one made of control strings, formatted, kept, and read back, with the turns out of order."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", CONTROL_TURN), (-7, 1, "assistant", CONTROL_TURN)], turns.schema)
    return read_back(keep(format_chat(turns.unionByName(extra)), "chat"))


@query("op7_hilbert_neighbours")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Ten nearest of each vector whose id is divisible by 100, among all others."""
    return nearest_neighbours(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


@query(
    "op8_warc",
    """
    with sized as (select page_id, coalesce(html, '') as html from pages),
    grouped as (
      select page_id, strlen(html) as payload_bytes, sha256(html) as payload_digest,
             min(page_id) over (partition by html) as lead from sized)
    select cast(page_id as bigint) as page_id, payload_bytes, payload_digest,
           case when payload_bytes >= 100 and page_id <> lead then 'revisit' else 'response' end as record_type,
           case when payload_bytes >= 100 and page_id <> lead then lead end as refers_to
    from grouped""",
)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """All pages written to archives and read back."""
    records = page_records(archive_pages(spark, table(spark, folder, "pages")))
    return records.withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})


@query("op9_source_mix")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Words that the mix takes of each document; weights 5, 2, 1 over the sources, 150 % of all words."""
    sizes, schedule = mix(table(spark, folder, "documents"))
    taken = taken_words(sizes, schedule)
    return taken.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


# The key of a real run is a secret of the caller; the query has a fixed one so that runs agree.
QUERY_KEY = b"pseudonym key of the query"


@query("op10_pii_pseudonyms")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """All documents with personal values replaced by pseudonyms."""
    done = pseudonymise_documents(table(spark, folder, "documents"), QUERY_KEY)
    return done.select(F.col("id").alias("doc_id"), "text", F.size("values").alias("n_values"), "values")


@query(
    "op11_benchmark_decontamination",
    r"""
    with texts as (
      select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words, row_number() over () as n
      from documents),
    items as (
      select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
      from benchmark),
    item_windows as (
      select distinct item_id, least(len(words), 10) as size, array_to_string(words[k : k + least(len(words), 10) - 1], ' ') as win
      from (select item_id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) as k from items where len(words) > 0)),
    sizes as (select distinct size from item_windows),
    text_windows as (
      select n, k, size, array_to_string(words[k : k + size - 1], ' ') as win
      from (select n, words, size, unnest(range(1, len(words) - size + 2)) as k from texts, sizes where len(words) >= size)),
    found as (select t.n, t.k, t.size, i.item_id from text_windows t join item_windows i on t.size = i.size and t.win = i.win),
    hits as (select n, count(distinct p) as n_hit from (select n, unnest(range(k, k + size)) as p from found) group by n),
    named as (
      select n, count(*) as n_items, string_agg(item, ',' order by item) as item_list
      from (select distinct n, cast(item_id as varchar) as item from found where item_id is not null) group by n)
    select doc_id, cast(len(words) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
           sha256(coalesce(item_list, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
    from texts left join hits using (n) left join named using (n)""",
)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Words of all documents that lie in ten-word windows of the benchmark, and the items they are from."""
    found = find_contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"), window=10)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["first"])
    return found.select(
        F.col("id").alias("doc_id"), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def byte_vocabulary() -> str:
    """Path of the first vocabulary file of the alignment query."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_vocabulary() -> str:
    """Path of the second."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op12_tokenizer_alignment")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """Groups and links of two tokenizers over all documents, links weighed by the corpus' counts."""
    counts = link_counts(table(spark, folder, "documents"), byte_vocabulary(), piece_vocabulary())
    return counts.withColumnRenamed("id", "doc_id")


def damaged(turns: DataFrame) -> DataFrame:
    """The turns after the damage that the repair query mends; nulls are one blank, a null turn stays without number."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn")).cast("binary")) % 20
    rows = turns.select(F.col("conv_id"), F.col("turn"), blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))
    return rows.filter("kind <> 0").select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times)
    ).drop("col")


@query("op13_conversation_repair")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations, damaged, with their faults and cheapest repairs."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    report, repaired = repair(damaged(turns), known=turns)
    digests = repaired_digest(repaired).withColumnRenamed("conv_id", "_id")
    whole = report.join(digests, F.col("conv_id").eqNullSafe(F.col("_id")), "left")
    empty = F.sha2(F.lit(""), 256)
    return whole.select(*report.drop("signs").columns, F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))
