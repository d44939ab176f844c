"""The registered queries of this subpackage and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from . import chat, decontaminate, embeddings, html_text, langid, line_dedup, packing, simhash, toxicity, url_filter


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def url_redirect_classes(spark, sf_dir):
    """URL rules on pages that redirect to the one before, or name an earlier one as canonical in their html."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    other = pages.select((F.col("page_id") + 1).alias("page_id"), F.col("url").alias("to"))
    redirects = pages.join(other, "page_id").where("page_id % 5 BETWEEN 1 AND 3").select(F.col("url").alias("src"), F.col("to").alias("dst"))
    first = pages.select((F.col("page_id") + 4).alias("page_id"), F.col("url").alias("to"))
    link = F.concat(F.lit('<link rel="canonical" href="'), F.replace("to", F.lit("&"), F.lit("&amp;")), F.lit('">'))
    linking = pages.join(first, "page_id", "left").withColumn("html", F.when(F.expr("page_id % 5 = 4"), F.coalesce(link, F.lit(""))).otherwise(""))
    return url_filter.filter_urls(linking.select("page_id", "url", "html"), url_filter.CONTRACT_RULES, redirects)


_NODE = "CASE WHEN contains({0}, '://') THEN lower(regexp_extract({0}, '^(.*?)://', 1, 's')) || '://' || {1} || CASE WHEN regexp_extract({0}, '^.*?://[^/?#]*([^#]*)', 1, 's') = '' THEN '/' ELSE regexp_extract({0}, '^.*?://[^/?#]*([^#]*)', 1, 's') END END"
URL_REDIRECT_SQL = f"""
WITH RECURSIVE r AS (SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN verdict END AS own FROM ({url_filter.OP3_SQL})),
n AS (SELECT page_id, url, {_NODE.format("url", url_filter._HOST.format("url"))} AS node FROM pages),
e AS (SELECT a.node AS a, b.node AS b FROM n a JOIN n b ON (a.page_id % 5 BETWEEN 1 AND 3 AND b.page_id = a.page_id - 1) OR (a.page_id % 5 = 4 AND b.page_id = a.page_id - 4)),
two AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT DISTINCT node AS a, node AS b FROM n WHERE node IS NOT NULL UNION SELECT reach.a, two.b FROM reach JOIN two ON reach.b = two.a),
said AS (SELECT reach.a AS node, bool_or(own = 'allow') AS allowed, bool_or(own = 'block') AS blocked FROM reach JOIN n ON n.node = reach.b JOIN r ON r.page_id = n.page_id GROUP BY 1)
SELECT r.page_id, host, path, rule, coalesce(own, CASE WHEN allowed THEN 'allow' WHEN blocked THEN 'block' END, 'allow') AS verdict
FROM r JOIN n USING (page_id) LEFT JOIN said ON said.node = n.node
"""


def chat_quoted_threads(spark, sf_dir):
    """Conversations in which every message that follows another quotes it."""
    chats = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    last = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    quoted = F.concat(F.lit("> "), F.replace(last, F.lit("\n"), F.lit("\n> ")), F.lit("\n"), F.coalesce("text", F.lit("")))
    out = chat.thread(chats.withColumn("text", F.coalesce(quoted, "text")))
    return out.select("conv_id", "turn", "reply_to", "root")


_NORMAL = "lower(trim(regexp_replace({0}, '[\\s\\x0B\\x{{a0}}]+', ' ', 'g'), ' '))"
CHAT_QUOTED_SQL = f"""
WITH RECURSIVE m AS (SELECT conv_id AS c, turn AS t, text AS x, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS q FROM conversations),
offer AS (SELECT c, u, min(t) AS first FROM (SELECT c, t, {_NORMAL.format("unnest(list_concat([x], list_concat(regexp_split_to_array(x, '\n[ \t\r]*\n'), string_split(x, chr(10)))))")} AS u FROM m WHERE x IS NOT NULL) WHERE u <> '' GROUP BY 1, 2),
quote AS (SELECT DISTINCT c, t, {_NORMAL.format("unnest(list_concat([q], list_concat(regexp_split_to_array(q, '\n[ \t\r]*\n'), string_split(q, chr(10)))))")} AS u FROM m WHERE q IS NOT NULL),
link AS (SELECT quote.c, t, arg_max(first, (length(quote.u), first)) AS parent FROM quote JOIN offer ON offer.c = quote.c AND offer.u = quote.u AND first < t GROUP BY 1, 2),
walk AS (SELECT c, t, parent AS up FROM link UNION SELECT walk.c, walk.t, link.parent FROM walk JOIN link ON link.c = walk.c AND link.t = walk.up),
root AS (SELECT c, t, min(up) AS root FROM walk GROUP BY 1, 2)
SELECT m.c AS conv_id, m.t AS turn, parent AS reply_to, coalesce(root, m.t) AS root FROM m LEFT JOIN link USING (c, t) LEFT JOIN root USING (c, t)
"""


def html_template_text(spark, sf_dir):
    """Main text of pages made of documents, one host a source, whose shell only its repetition tells from the text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    body = F.coalesce("text", F.lit(""))
    for sign, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        body = F.replace(body, F.lit(sign), F.lit(ref))
    page = F.concat(F.lit("<div><p>Home</p><p>About us</p></div><div class='x'><p>"), body, F.lit("</p></div><div><p>Imprint</p></div>"))
    url = F.concat(F.lit("http://h"), F.coalesce("source", F.lit("")), F.lit(".org/"), F.col("doc_id").cast("string"))
    return html_text.extract(docs.select(F.col("doc_id").alias("page_id"), url.alias("url"), page.alias("html"))).select("page_id", "text")


HTML_TEMPLATE_SQL = "SELECT doc_id AS page_id, trim(regexp_replace(coalesce(text, ''), '[\\s\\x0B\\x1c-\\x1f\\x{85}\\x{a0}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{3000}]+', ' ', 'g'), ' ') AS text FROM documents"


def queries():
    return {
        "pipeline": pipeline,
        "op1_simhash": simhash.op1_simhash,
        "op2_embeddings": embeddings.op2_embeddings,
        "op3_url_filter": url_filter.op3_url_filter,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_langid": langid.op5_langid,
        "op6_chat": chat.op6_chat,
        "op7_line_dedup": line_dedup.op7_line_dedup,
        "op8_html_text": html_text.op8_html_text,
        "op9_decontaminate": decontaminate.op9_decontaminate,
        "op10_packing": packing.op10_packing,
        # the dealt methods at work on links, quotations and templates that the tables lack
        "url_redirect_classes": url_redirect_classes,
        "chat_quoted_threads": chat_quoted_threads,
        "html_template_text": html_template_text,
    }


def oracle_sql():
    return {"op3_url_filter": url_filter.OP3_SQL, "op7_line_dedup": line_dedup.OP7_SQL, "url_redirect_classes": URL_REDIRECT_SQL, "chat_quoted_threads": CHAT_QUOTED_SQL, "html_template_text": HTML_TEMPLATE_SQL}
