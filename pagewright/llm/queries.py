"""Registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _register(name: str):
    def add(run):
        QUERIES[name] = run
        return run

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_register("op6_chosen_path_near_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chosen_path import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


@_register("op10_prefix_target_chat")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import chat_examples, conversation_digests

    said = "\\### Assistant: </turn> ok"
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return conversation_digests(chat_examples(turns.unionByName(more)))


ORACLES["op10_prefix_target_chat"] = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as place,
    9 + length(replace(replace(replace(replace(role, '\', '\b'), '</turn>', '\c'), '<turn ', '\o'), '>', '\g'))
      + length(replace(replace(replace(text, '\', '\b'), '</turn>', '\c'), '<turn ', '\o')) + 7 as chars
  from turns
), summed as (
  select *, sum(chars) over (partition by conv_id order by place) as so_far,
    count(*) over (partition by conv_id) as n
  from sized
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by place)) as turns_sha256,
  length(coalesce(string_agg(text, '' order by place) filter (role = 'assistant'), '')) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by place) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(case when role = 'assistant' or place = n then so_far else 0 end) as bigint) as formatted_chars
from summed group by conv_id
"""


@_register("op2_mixture_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import Packing, pack_documents, special_tokens

    docs = _table(spark, sf_dir, "documents")
    cfg = Packing(specials=special_tokens(public_tokenizers.path("byte_bpe_50k.json")))
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, cfg)


RULES = {
    "com/": "allow",
    "example.com/en/": "block",
    "www.example.com/en/": "allow",
    "net/es/": "block",
    "net/fr/": "block",
}


@_register("op3_url_templates")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_templates import judge_urls

    return judge_urls(_table(spark, sf_dir, "pages"), RULES)


@_register("op8_ftrl_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity_scores

    return toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_register("op1_sentencepiece_fst")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and the text decoded from them, per document."""
    import public_tokenizers

    from .sentencepiece_fst import decode_ids, encode_texts

    model = public_tokenizers.path("piece_bpe_32k.model")
    decoded = decode_ids(encode_texts(_table(spark, sf_dir, "documents"), model), model)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        F.xxhash64("ids").alias("ids_hash"),
        F.length("text").cast("long").alias("decoded_chars"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


@_register("op9_iblt_fingerprints")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import fingerprint_versions

    return fingerprint_versions(_table(spark, sf_dir, "documents"))


@_register("op7_pivot_permutation")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pivot_index import linked_vectors

    return linked_vectors(_table(spark, sf_dir, "embeddings"))


@_register("op5_suffix_array_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import repeated_bytes

    return repeated_bytes(_table(spark, sf_dir, "documents"))


@_register("op4_paragraph_minhash")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .paragraph_dedup import repeated_paragraphs

    return repeated_paragraphs(_table(spark, sf_dir, "documents"))


@_register("op12_fill_in_middle")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fill_middle import fill_in_middle, restored_text

    made = fill_in_middle(_table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored_text(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


ORACLES["op12_fill_in_middle"] = r"""
with told as (
  select doc_id, coalesce(text, '') as text, sha256('7:' || coalesce(cast(doc_id as varchar), '')) as h from documents
), cut as (
  select doc_id, text, string_split(text, chr(10)) as parts,
    len(string_split(text, chr(10))) - case when text = '' or text like '%' || chr(10) then 1 else 0 end as n,
    cast('0x' || substr(h, 1, 8) as bigint) as h1, cast('0x' || substr(h, 9, 8) as bigint) as h2,
    cast('0x' || substr(h, 17, 8) as bigint) as h3, cast('0x' || substr(h, 25, 8) as bigint) as h4
  from told
), placed as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as low, greatest(h1 % (n + 1), h2 % (n + 1)) as high from cut
), ended as (
  select *,
    case when low = 0 then '' when low = len(parts) then text else array_to_string(parts[1:low], chr(10)) || chr(10) end as one,
    case when high = 0 then '' when high = len(parts) then text else array_to_string(parts[1:high], chr(10)) || chr(10) end as two,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 100
      then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form
  from placed
), pieces as (
  select doc_id, n, form, text, one as prefix, substr(two, length(one) + 1) as middle, substr(text, length(two) + 1) as suffix
  from ended
)
select doc_id, cast(n as bigint) as n, form,
  case when form <> 'plain' then length(prefix) end as prefix_chars,
  case when form <> 'plain' then length(middle) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(text) as restored_sha256
from pieces
"""


@_register("op13_prefix_trie")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import conversation_trie

    return conversation_trie(_table(spark, sf_dir, "conversations"))


#: DuckDB has no crc32: it is folded bit by bit over the digits of the id.
ORACLES["op13_prefix_trie"] = r"""
with turns as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first,
      md5(cast(length(coalesce(role, '')) as varchar) || ',' || coalesce(role, '') || coalesce(text, ''))) as place
  from conversations where conv_id is not null
), ids as (
  select conv_id, conv_id - conv_id % 100 as base,
    xor(4294967295, list_reduce(
      list_concat([4294967295], flatten(list_transform(string_split(cast(conv_id as varchar), ''), lambda d: [cast(ascii(d) as bigint), -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, b: case when b >= 0 then xor(c, b) else xor(c >> 1, 3988292384 * (c & 1)) end)) % 6 as h
  from (select distinct conv_id from turns)
), moved as (
  select i.conv_id, t.place as d, t.role, t.text from ids i join turns t on t.conv_id = i.base where t.place <= i.h
  union all
  select i.conv_id, least(i.h, coalesce(b.n, 0)) + t.place - i.h, t.role, t.text
  from ids i join turns t on t.conv_id = i.conv_id and t.place > i.h
  left join (select conv_id, count(*) as n from turns group by conv_id) b on b.conv_id = i.base
), prefixes as (
  select conv_id, d, text, string_agg(md5(cast(length(role) as varchar) || ',' || role || text), '')
    over (partition by conv_id order by d) as prefix
  from moved
  union all select conv_id, 0, '', '' from ids
), sizes as (
  select conv_id, max(d) as size from prefixes group by conv_id
), nodes as (
  select prefix, d as depth, min(conv_id) as conv_id, count(*) as n_convs, min(length(text)) as chars,
    sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (d = size), '')) as ends_sha256
  from prefixes join sizes using (conv_id) group by prefix, d
), edges as (
  select n.prefix, n.depth, p.prefix as parent, q.conv_id as parent_conv_id from nodes n
  left join prefixes p on p.conv_id = n.conv_id and p.d = n.depth - 1 left join nodes q on q.prefix = p.prefix
), children as (
  select parent as prefix, count(*) as n from edges where parent is not null group by parent
), below as (
  select a.prefix, count(*) filter (c.n is null) as n_leaves, sum((v.n_convs - 1) * v.chars) as saved
  from nodes v join prefixes a on a.conv_id = v.conv_id and a.d <= v.depth left join children c on c.prefix = v.prefix
  group by a.prefix
)
select n.conv_id, cast(n.depth as bigint) as depth, e.parent_conv_id, n.n_convs, coalesce(c.n, 0) as n_children,
  b.n_leaves, cast(b.saved as bigint) as saved_tokens, n.ends_sha256
from nodes n join edges e using (prefix) left join children c using (prefix) join below b using (prefix)
"""


@_register("op11_tree_model_extraction")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extraction import extract_text

    return extract_text(_table(spark, sf_dir, "pages"))
