"""Queries of chunks, tables, figures and causes in documents. Texts are made from events, so that SQL can say what comes out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ferrolens.operators import chunks as C
from ferrolens.plans.registry import query
from ferrolens.plans.views import table


def told(*parts) -> Column:
    """The parts as one string: text, or columns."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def k() -> Column:
    return F.col("event_id")

PAGES = """pages_ as (
        select doc_id, regexp_extract_all(text, '(?s).{1,900}') as parts from documents
    ), trimmed as (
        select doc_id, unnest(range(1, len(parts) + 1)) as page, regexp_replace(unnest(parts), '\\s+$', '') as text from pages_
    )"""


@query("src4_chunk_pages", f"with {PAGES} select doc_id as document_id, page, cast(length(text) as bigint) as chars from trimmed where text <> ''")
def src4(spark, sf):
    """How far each page's chunks reach: to the page's end."""
    parts = table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode(F.regexp_extract_all("text", F.lit("(?s).{1,900}"), 0)).alias("page", "text"))
    pages = parts.select("document_id", (F.col("page") + 1).cast("long").alias("page"), F.regexp_replace("text", r"[ \t\n\f\r]+$", "").alias("text"))
    return C.chunk_pages(pages).groupBy("document_id", "page").agg(F.max("char_end").cast("long").alias("chars"))


def spoken(spark, sf):
    """Turns of conversations as paragraphs, each with one of the vectors at hand."""
    vectors = table(spark, sf, "embeddings")
    n = vectors.agg(F.count("*").alias("n"))
    turns = table(spark, sf, "conversations").join(F.broadcast(n)).withColumn("vec_id", (F.col("conv_id") * 31 + F.col("turn")) % F.col("n"))
    return turns.join(vectors, "vec_id").select(F.col("conv_id").alias("document_id"), F.col("turn").cast("int").alias("place"), F.coalesce("text", F.lit("")).alias("text"), F.col("embedding").alias("vector"))


@query(
    "doc4_chunk_semantic",
    """with recursive p as (
        select conv_id, row_number() over (partition by conv_id order by turn) as k, coalesce(text, '') as text, list_transform(embedding, lambda x: x::double) as v
        from conversations join embeddings on vec_id = (conv_id * 31 + turn) % (select count(*) from embeddings)
    ), s as (
        select a.conv_id, a.k, a.text, coalesce(list_cosine_similarity(a.v, b.v), 0) as likeness from p a left join p b on a.conv_id = b.conv_id and b.k = a.k - 1
    ), w as (
        select conv_id, k, text as held, 0 as chunk_index from s where k = 1
        union all
        select s.conv_id, s.k, case when likeness >= 0.05 and length(held) + length(text) <= 700 then held || chr(10) || chr(10) || text else text end,
            chunk_index + (not (likeness >= 0.05 and length(held) + length(text) <= 700))::int
        from w join s on s.conv_id = w.conv_id and s.k = w.k + 1
    )
    select conv_id as document_id, chunk_index, md5(arg_max(held, k)) as digest from w group by all""",
)
def doc4(spark, sf):
    return C.chunk_semantic(spoken(spark, sf), 0.05, 700).select("document_id", "chunk_index", F.md5("text").alias("digest"))


@query("doc5_repair_chunk_sizes")
def doc5(spark, sf):
    """Chunks of conversations, a turn each, made of a fair size."""
    return C.repair_chunk_sizes(spoken(spark, sf).select("document_id", F.col("place").alias("chunk_index"), "text"))


@query("doc6_chunk_documents")
def doc6(spark, sf):
    """Documents with a line that ends in a colon count as Markdown here."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.regexp_replace("text", r"(?m)^([^\n|]{3,60}:)$", "## $1").alias("text"))
    return C.chunk_documents(docs.filter("text is not null").withColumn("is_markdown", F.col("text").rlike(r"(?m)^#{1,6}\s+\S")))


@query(
    "doc7_flatten_tables",
    """select event_id, 'intro | no table' || chr(10) || 'Sensor: ' || event_type || ', Value: ' || event_id || '.' || chr(10) || 'Value: b.' || chr(10) || 'Sensor: x, Value: y, Note: z ' || user_id || '.' || chr(10) || 'after' || chr(10) || '| lone |' as text from events""",
)
def doc7(spark, sf):
    rows = told("intro | no table\n| Sensor | Value | Note |\n  |---|:--:|---|\n| ", F.col("event_type"), " | ", k(), " |  |\n|  | b |\n| x | y | z ", F.col("user_id"), " | more |\nafter\n| lone |")
    return table(spark, sf, "events").select("event_id", C.flattened_text(rows).alias("text"))


SEEN = "'See Figure 3.' || event_id || ', 표 ' || user_id || '; fig. 2-1 and Photograph 7, 도면1. Table'"


@query(
    "doc14_figure_references",
    f"""with d as (select event_id, user_id, {SEEN} as text from events)
    select event_id as document_id, 'figure' as type, '3.' || event_id as id, cast(strpos(text, 'Figure') - 1 as integer) as position from d
    union all select event_id, 'table', cast(user_id as varchar), cast(strpos(text, '표') - 1 as integer) from d
    union all select event_id, 'figure', '2-1', cast(strpos(text, 'fig.') - 1 as integer) from d
    union all select event_id, 'photo', '7', cast(strpos(text, 'Photograph') - 1 as integer) from d
    union all select event_id, 'diagram', '1', cast(strpos(text, '도면') - 1 as integer) from d""",
)
def doc14(spark, sf):
    text = told("See Figure 3.", k(), ", 표 ", F.col("user_id"), "; fig. 2-1 and Photograph 7, 도면1. Table")
    return C.figure_references(table(spark, sf, "events").select(k().alias("document_id"), text.alias("text")), ("document_id",))


def captioned(spark, sf):
    text = told("Figure 1.", k(), ": The ", F.col("event_type"), " pump\nFig. 1.", k(), " - again\n표 2: 요약 표\nphoto 3: n")
    return table(spark, sf, "events").select(k().alias("document_id"), text.alias("text"))


@query("doc15_caption_map", "select event_id as document_id, 'figure' as type, '1.' || event_id as id, 'The ' || event_type || ' pump' as caption from events union all select event_id, 'table', '2', '요약 표' from events")
def doc15(spark, sf):
    return C.caption_map(captioned(spark, sf))


@query(
    "doc16_enrich",
    """select event_id as document_id, 0 as chunk_index, 'As table 2 and Figure 1.' || event_id || ' show, unlike Figure 9' || chr(10) || chr(10) || '[TABLE 2: 요약 표]' || chr(10) || '[FIGURE 1.' || event_id || ': The ' || event_type || ' pump]' as text from events
    union all select event_id, 1, 'nothing here' from events""",
)
def doc16(spark, sf):
    events = table(spark, sf, "events")
    parts = events.select(k().alias("document_id"), F.lit(0).alias("chunk_index"), told("As table 2 and Figure 1.", k(), " show, unlike Figure 9").alias("text"))
    parts = parts.unionByName(events.select(k().alias("document_id"), F.lit(1).alias("chunk_index"), F.lit("nothing here").alias("text")))
    return C.enrich_with_captions(parts, C.caption_map(captioned(spark, sf))).select("document_id", "chunk_index", "text")


@query(
    "doc17_tables_from_words",
    """with l as (select l_orderkey, l_linenumber, count(*) over (partition by l_orderkey) as n, count(*) over (partition by l_orderkey, l_linenumber) as same,
        '| ' || l_returnflag || ' ' || l_linestatus || ' | ' || l_suppkey || ' | ' || l_partkey || ' |' as line from lineitem)
    select l_orderkey as document_id, 1 as page, string_agg(line || case when k = 1 then chr(10) || '| --- | --- | --- |' else '' end, chr(10) order by k) as "table"
    from (select *, row_number() over (partition by l_orderkey order by l_linenumber) as k from l) where n >= 3 and l_orderkey not in (select l_orderkey from l where same > 1) group by 1""",
)
def doc17(spark, sf):
    """Order lines as rows of words on a page, in three columns, the first of two words; bottoms within a row differ a little."""
    line = table(spark, sf, "lineitem")
    once = line.groupBy("l_orderkey", "l_linenumber").count().groupBy("l_orderkey").agg(F.max("count").alias("most")).filter("most = 1").select("l_orderkey")
    bottom = 700.0 - 20 * F.col("l_linenumber")
    word = lambda left, right, c, off=0.0: F.struct(F.lit(left).alias("left"), F.lit(right).alias("right"), (bottom + off).alias("bottom"), F.col(c).cast("string").alias("text"))
    words = F.explode(F.array(word(0.0, 10.0, "l_returnflag"), word(15.0, 30.0, "l_linestatus", 1.5), word(100.0, 130.0, "l_suppkey", -1.0), word(200.0, 240.0, "l_partkey")))
    page = line.join(once, "l_orderkey", "left_semi").select(F.col("l_orderkey").alias("document_id"), F.lit(1).alias("page"), words.alias("w")).select("document_id", "page", "w.*")
    return C.tables_from_words(page)


@query(
    "doc18_pack_batches",
    """with recursive c as (
        select conv_id, row_number() over (partition by conv_id order by turn) as k, substr(coalesce(text, ''), 1, 400) as t from conversations
    ), w as (
        select conv_id, k, t as held, 0 as batch_index from c where k = 1
        union all
        select c.conv_id, c.k, case when length(held) > 0 and length(held) + length(t) + 2 > 400 then t when length(held) = 0 then t else held || chr(10) || chr(10) || t end,
            batch_index + (length(held) > 0 and length(held) + length(t) + 2 > 400)::int
        from w join c on c.conv_id = w.conv_id and c.k = w.k + 1
    )
    select conv_id as document_id, batch_index, md5(arg_max(held, k)) as digest from w group by all having arg_max(held, k) <> ''""",
)
def doc18(spark, sf):
    parts = spoken(spark, sf).select("document_id", F.col("place").alias("chunk_index"), "text")
    return C.pack_batches(parts, 400).select("document_id", "batch_index", F.md5("text").alias("digest"))


def manual(spark, sf, by="event_id"):
    """Chunks with a labelled block with a code, a cause alone, or two conditional sentences; each event is a chunk of its own number."""
    kind, number = F.col("event_type"), (1000 + k() % 900).cast("string")
    block = told("Alarm E-", number, " again\nSymptom: ", kind, " pump\nRoot cause: worn ", kind, number, "\nAction: replace it\nthe end")
    alone = told("Cause - dirty filter ", k() % 7, "\n")
    sentences = told("If pressure drops, check valve ", k() % 5, ". If A", 100 + k() % 50, " rises, then stop.")
    text = F.when(k() % 3 == 0, block).when(k() % 3 == 1, alone).otherwise(sentences)
    return table(spark, sf, "events").select(F.col(by).alias("document_id"), k().alias("chunk_index"), text.alias("text"))


BLOCKS = """select {0} as document_id, 'E-' || (1000 + event_id % 900) as error_code, event_type || ' pump' as symptom, 'worn ' || event_type || (1000 + event_id % 900) as cause, 'replace it' as action, 0.7::double as confidence from events where event_id % 3 = 0
    union all select {0}, null, '', 'dirty filter ' || event_id % 7, '', 0.5::double from events where event_id % 3 = 1"""
SENTENCES = """select {0} as document_id, null as error_code, 'pressure drops' as symptom, '' as cause, 'valve ' || event_id % 5 as action, 0.4::double as confidence from events where event_id % 3 = 2
    union all select {0}, 'A' || (100 + event_id % 50), 'A' || (100 + event_id % 50) || ' rises', '', 'stop', 0.4::double from events where event_id % 3 = 2"""


@query("cau2_causal_from_blocks", BLOCKS.format("event_id"))
def cau2(spark, sf):
    return C.causal_from_blocks(manual(spark, sf))


@query("cau3_causal_from_conditionals", SENTENCES.format("event_id"))
def cau3(spark, sf):
    return C.causal_from_conditionals(manual(spark, sf))


@query(
    "cau4_extract_causal",
    f"""with every as ({BLOCKS.format("user_id")} union all {SENTENCES.format("user_id")}), k as (
        select *, row_number() over (partition by document_id, lower(coalesce(error_code, '')), lower(cause) order by confidence desc, symptom, action) as k from every
    ) select document_id, error_code, symptom, cause, action, confidence from k where k = 1""",
)
def cau4(spark, sf):
    return C.extract_causal(manual(spark, sf, "user_id"))


@query(
    "doc1_sections",
    """select event_id as document_id, 0 as place, '' as section, 'lead' as text from events union all select event_id, 1, 'Pump ' || event_id, 'Body.' from events
    union all select event_id, 2, 'Pump ' || event_id || ' > ' || event_type, 'More #1' from events union all select event_id, 3, 'End', '#######x' from events""",
)
def doc1(spark, sf):
    text = told("lead\n# Pump ", k(), "\nBody.\n\n### ", F.col("event_type"), " \nMore #1\n## Blank\n \n# End\n#######x")
    return C.sections_of(table(spark, sf, "events").select(k().alias("document_id"), text.alias("text")))
