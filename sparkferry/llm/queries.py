"""The registered queries of the corpus operators and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES = {}
ORACLES = {}


def register(name, sql=None):
    def put(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The filter rules that op1 is asked for: action, host and path.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


@register(
    "op1_url_filters",
    r"""with p as (select page_id, row_number() over () as rid, coalesce(url, '') as u from pages),
q as (select page_id, rid, translate(regexp_extract(u, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(u, '^.*?://([^/?#]*)([^?#]*)', 2, 's') as path from p),
r(action, h, pre) as (values ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m as (select q.*, h || pre as rule, action, row_number() over (partition by rid order by length(h || pre) desc nulls last) as k
  from q left join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, pre))
select page_id, host, path, rule, coalesce(action, 'allow') as verdict from m where k = 1""",
)
def op1_url_filters(spark, sf_dir):
    from sparkferry.llm.url_filters import judge, rules_frame

    return judge(table(spark, sf_dir, "pages"), rules_frame(spark, URL_RULES))


@register(
    "op8_chat_formatting",
    r"""with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
e as (select *, replace(replace(replace(replace(text, '\', '\s'), '###', '\h'), '</turn>', '\e'), '<part/>', '\p') as esc,
  replace(replace(replace(replace(replace(role, '\', '\s'), '###', '\h'), '</turn>', '\e'), '<part/>', '\p'), ':', '\c') as rol,
  lag(role) over (partition by conv_id order by turn, role, text) is not distinct from role as joined from c)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(length(esc) + case when joined then 7 else length(rol) + 14 end) as bigint) as formatted_chars
from e group by conv_id""",
)
def op8_chat_formatting(spark, sf_dir):
    from pyspark.sql import functions as F

    from sparkferry.llm.chat import format_chat, read_back, under_loss
    from sparkferry.llm._frames import pick

    odd = r"\### Assistant: </turn> ok"
    planted = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(-7).cast("bigint").alias("conv_id"), F.lit(i).cast("bigint").alias("turn"), F.lit(r).alias("role"), F.lit(odd).alias("text")) for i, r in enumerate(("user", "assistant"))])))
    rows = pick(table(spark, sf_dir, "conversations"), conv_id="conv_id", turn="turn", role="role", text="text").unionByName(planted)
    out = format_chat(rows)
    out = out.select("conv_id", F.length("formatted").cast("bigint").alias("formatted_chars"), read_back(F.col("formatted")).alias("turns"), F.array_join(under_loss(F.col("formatted"), F.col("loss")), "").alias("under"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("under").cast("bigint").alias("loss_chars"), F.sha2("under", 256).alias("loss_sha256"), "formatted_chars")


@register("op2_packing")
def op2_packing(spark, sf_dir):
    from pyspark.sql import functions as F

    from sparkferry.llm.packing import pack

    out = pack(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("piece_start").alias("start"), F.col("piece_length").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", F.lit(0).cast("long").alias("offset"), "bucket")


@register("op3_tree_bpe")
def op3_tree_bpe(spark, sf_dir):
    from pyspark.sql import functions as F

    from sparkferry.llm.tree_bpe import decode, encode

    ids = encode(table(spark, sf_dir, "documents"))
    out = decode(ids, keep=("doc_id", "ids"))
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@register("op6_ogg_media")
def op6_ogg_media(spark, sf_dir):
    from pyspark.sql import functions as F

    from sparkferry.llm.ogg import read_media, to_media

    back = read_media(to_media(table(spark, sf_dir, "documents")), keep=("doc_id", "media"))
    return back.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )


@register("op9_secret_scans")
def op9_secret_scans(spark, sf_dir):
    from pyspark.sql import functions as F

    from sparkferry.llm.secrets import BASE, scan

    out = scan(table(spark, sf_dir, "documents"))
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [of(k).alias(f"n_{k}") for k in BASE]
    return out.select("doc_id", *counts, F.sha2(line(F.filter("spans", lambda s: s["kind"].isin(*BASE))), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))


@register("op4_language_id")
def op4_language_id(spark, sf_dir):
    from pyspark.sql import functions as F

    from sparkferry.llm.lang_id import held_out, identify, learn

    docs = table(spark, sf_dir, "documents")
    out = identify(docs, learn(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@register("op10_toxicity")
def op10_toxicity(spark, sf_dir):
    from pyspark.sql import functions as F

    from sparkferry.llm.lang_id import held_out
    from sparkferry.llm.toxicity import learn, score

    docs = table(spark, sf_dir, "documents")
    out = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@register("op7_probminhash_near_dup")
def op7_probminhash_near_dup(spark, sf_dir):
    from sparkferry.llm.near_dup import grouped

    return grouped(table(spark, sf_dir, "documents"))


@register("op5_cover_tree_near_dup")
def op5_cover_tree_near_dup(spark, sf_dir):
    from sparkferry.llm.embed_dup import grouped

    return grouped(table(spark, sf_dir, "embeddings"))
