"""One registered query for each operator, over the whole of its table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import (
    alignment,
    bpe,
    chat,
    divergence,
    extraction,
    fingerprints,
    jaccard,
    mixing,
    neighbours,
    quality,
    secrets,
    sharding,
    toxicity,
)
from millrace.llm.labelled import fold
from millrace.llm.ordered import with_next
from millrace.queries.registry import query, table
from millrace.sources.scratch import new_path, stage_table

#: The shards of ``op4_lookup_sharding``.
SHARDS = tuple(f"shard-{k:03d}" for k in range(256))


def _hex(text: Column) -> Column:
    return F.sha2(text, 256)


@query("op1_fingerprints")
def op1_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n_chars = F.length("text").cast("long")
    part = F.floor(n_chars / 4).cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), (n_chars - part).cast("int")), F.substring("next_text", F.lit(1), part)
    )
    pairs = with_next(docs, "doc_id", "text", "next_text").withColumns({"n_chars": n_chars, "edited": edited})
    sketched = pairs.select(
        "doc_id",
        "n_chars",
        _hex(F.col("edited")).alias("edited_sha256"),
        fingerprints.fingerprint(F.col("text")).alias("own"),
        fingerprints.fingerprint(F.col("edited")).alias("changed"),
        fingerprints.fingerprint(F.col("next_text")).alias("next"),
    )
    own, changed, following = F.col("own"), F.col("changed"), F.col("next")
    return sketched.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprints.as_text(own).alias("fingerprint"),
        fingerprints.as_text(changed).alias("edited_fingerprint"),
        fingerprints.likeness(own, changed).alias("near_edited"),
        fingerprints.likeness(own, following).alias("near_next"),
        fingerprints.containment(own, changed).alias("held_by_edited"),
    )


def _scored(df: DataFrame, held_out: Column, score: Column, least: float) -> DataFrame:
    return df.select("doc_id", held_out.alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= least).cast("int")
    )


@query("op2_quality_ranking")
def op2_quality_ranking(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = fold(F.col("doc_id"), 3) == 1
    model = quality.train(docs, table(spark, folder, "labels"), ~held_out)
    return _scored(docs, held_out, quality.score(model, F.col("text")), 0.5)


@query("op3_entropy_mixing")
def op3_entropy_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    sized = stage_table(docs.select("doc_id", "source", mixing.size_of(F.col("text")).alias("size")), "sized")
    return (
        mixing.mix(sized)
        .withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
        .select(
            "doc_id",
            "size",
            "source_size",
            "target",
            (F.col("size") * F.col("copies")).alias("taken"),
            "copies",
            "rate",
        )
    )


_SLOT_SQL = f"""CAST(CAST('0x' || substr(sha256(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT)
    % {sharding.SLOTS} AS INTEGER)"""


@query(
    "op4_lookup_sharding",
    # The table itself is filled by turns, which SQL cannot say; it is given as a string of bytes.
    f"""SELECT doc_id, slot, CAST(CAST('0x' || substr(
        '{"".join(f"{x:02x}" for x in sharding.lookup_table(SHARDS))}', 2 * slot + 1, 2) AS BIGINT) AS INTEGER) AS shard
        FROM (SELECT doc_id, {_SLOT_SQL} AS slot FROM documents)""",
)
def op4_lookup_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.place(table(spark, folder, "documents"), "doc_id", SHARDS).select("doc_id", "slot", "shard")


def _located(kind: str, pattern: str, options: str, group: int, least: int) -> str:
    """SQL for the spans of a rule: gaps between matches and lengths of matches, summed up."""
    wholes = f"list_transform(regexp_extract_all(text, '{pattern}', 0, '{options}'), lambda x: length(x))"
    gaps = f"list_transform(string_split_regex(text, '{pattern}', '{options}'), lambda x: length(x))"
    kept = f"list_transform(regexp_extract_all(text, '{pattern}', {group}, '{options}'), lambda x: length(x))"
    return f"""SELECT doc_id, '{kind}' AS kind, i, list_sum(gaps[1:i]) + coalesce(list_sum(wholes[1:i - 1]), 0) AS s,
        list_sum(gaps[1:i]) + list_sum(wholes[1:i]) AS e
        FROM (SELECT *, unnest(range(1, len(wholes) + 1)) AS i FROM (
            SELECT doc_id, {gaps} AS gaps, {wholes} AS wholes, {kept} AS kept
            FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)))
        WHERE kept[i] >= {least}"""


_BASE_SQL = " UNION ALL ".join(
    [
        _located(
            "assign",
            r"""(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""",
            "i",
            2,
            6,
        ),
        _located("access", "AKIA[A-Z0-9]+", "c", 0, 20),
        _located("hex", "[0-9a-f]+", "c", 0, 24),
    ]
)
_MORE_SQL = " UNION ALL ".join(
    [
        _located("github", "gh[pousr]_[A-Za-z0-9]{36,}", "c", 0, 1),
        _located("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", "c", 0, 1),
    ]
)
_ORDER_SQL = "list_position(['assign', 'access', 'hex', 'github', 'private_key'], kind)"


def _joined(spans: str) -> str:
    return f"""SELECT doc_id, string_agg(concat_ws(':', kind, CAST(s AS BIGINT), CAST(e AS BIGINT)), ','
        ORDER BY s, {_ORDER_SQL}) AS spans, count(*) FILTER (kind = 'assign') AS n_assign,
        count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex
        FROM ({spans}) GROUP BY doc_id"""


@query(
    "op5_secret_ledger",
    f"""SELECT d.doc_id, coalesce(b.n_assign, 0) AS n_assign, coalesce(b.n_access, 0) AS n_access,
        coalesce(b.n_hex, 0) AS n_hex, sha256(coalesce(b.spans, '')) AS base_sha256,
        coalesce(a.spans, '') AS spans
        FROM documents d LEFT JOIN ({_joined(_BASE_SQL)}) b USING (doc_id)
        LEFT JOIN ({_joined(f"{_BASE_SQL} UNION ALL {_MORE_SQL}")}) a USING (doc_id)""",
)
def op5_secret_ledger(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    ledger = new_path(spark, "secret-ledger")
    secrets.scan(docs, ledger)
    found = secrets.findings(docs, ledger).drop("text")
    base = F.filter("found", lambda f: f["kind"].isin(*(rule.kind for rule in secrets.BASE)))

    def number(kind: str) -> Column:
        return F.size(F.filter("found", lambda f: f["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *(number(rule.kind).alias(f"n_{rule.kind}") for rule in secrets.BASE),
        _hex(secrets.listed(base)).alias("base_sha256"),
        secrets.listed(F.col("found")).alias("spans"),
    )


@query("op6_projected_neighbours")
def op6_projected_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query("op7_jaccard_join")
def op7_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.jaccard_groups(table(spark, folder, "documents").select("doc_id", "text"))


@query("op8_toxicity_machine")
def op8_toxicity_machine(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = toxicity.train(docs, table(spark, folder, "labels"), ~held_out)
    return _scored(docs, held_out, toxicity.score(model, F.col("text")), 0.3)


_EDGE_TEXT = "</s>[INST] ok [/INST]"


def _escaped(column: str) -> str:
    """SQL that doubles backslashes and puts one after the first character of control strings."""
    rests = "|".join(c[1:].replace("|", r"\|").replace("]", r"\]") for c in chat.CONTROLS)
    # All control strings begin with < or [, and none with the rest of one that begins otherwise.
    return rf"""regexp_replace(replace({column}, '\', '\\'), '([<\[])({rests})', '\1\\\2', 'g')"""


_TURNS_SQL = f"""SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '{_EDGE_TEXT}' UNION ALL SELECT -7, 1, 'assistant', '{_EDGE_TEXT}'"""


#: Larger conversations stay rows: a parsed record may take 16 MB.
RECORD_BYTES = 4 << 20


def in_many_layouts(turns: DataFrame) -> DataFrame:
    """Conversations turned into records of several layouts and back, those that can be.

    Such of a user and an assistant become a prompt and its completion, such with a system turn
    before an instruction; others, by the hash of their id, a list of messages, a list under the other
    names of roles, or stay rows. Roles that have another name (``chat.ROLES``) stay as they are.
    """
    role, text = (F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text"))
    one = F.struct(F.col("turn").isNotNull().alias("known"), "turn", role, text)
    size = F.sum(F.octet_length(role) + F.octet_length(text))
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("all"), size.alias("bytes"))
    roles, texts = F.transform("all", lambda t: t["role"]), F.transform("all", lambda t: t["text"])
    names = {"user": "human", "assistant": "gpt"}
    other = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    third = F.pmod(F.xxhash64("conv_id"), F.lit(3))

    def fields(*names: str) -> Column:
        return F.to_json(F.struct(*(F.get(texts, k).alias(name) for k, name in enumerate(names))))

    messages = F.transform("all", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))
    values = F.transform(
        "all", lambda t: F.struct(F.coalesce(other[t["role"]], t["role"]).alias("from"), t["text"].alias("value"))
    )
    record = (
        F.when(F.exists(roles, lambda r: r.isin(*chat.ROLES)) | (F.col("bytes") > RECORD_BYTES), F.lit(None))
        .when(roles == F.array(F.lit("user"), F.lit("assistant")), fields("prompt", "completion"))
        .when(roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant")), fields("instruction", "input", "output"))
        .when(third == 0, F.to_json(F.struct(F.col("conv_id").alias("id"), messages.alias("messages"))))
        .when(third == 1, F.to_json(F.struct(values.alias("conversations"))))
    )
    read = grouped.withColumn("record", record).withColumn("made", chat.record_turns(F.col("record"))["turns"])
    lost = F.raise_error(F.lit("a record fits no layout")).cast("array<struct<role:string,text:string>>")
    plain = F.transform("all", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    whole = F.when(F.col("record").isNull(), plain).otherwise(F.coalesce("made", lost))
    return read.select("conv_id", F.posexplode(whole).alias("turn", "t")).select("conv_id", "turn", "t.role", "t.text")


@query(
    "op9_chat_formatting",
    f"""SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
        CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text), ''))
            AS loss_sha256,
        CAST(sum({sum(map(len, chat.CONTROLS[:3]))} + length({_escaped("role")}) + length({_escaped("text")})) AS BIGINT)
            AS formatted_chars
        FROM ({_TURNS_SQL}) GROUP BY conv_id""",
)
def op9_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    turns = chat.turns_of_rows(in_many_layouts(chat.turns_of_rows(table(spark, folder, "conversations"))))
    edge = spark.sql(
        "SELECT -7L AS conv_id, turn, role, :text AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)",
        args={"text": _EDGE_TEXT},
    )
    out = chat.format_turns(turns.unionByName(edge))
    read = out.select(
        "conv_id",
        chat.read_turns(F.col("formatted")).alias("turns"),
        F.array_join(chat.read_loss(F.col("formatted"), F.col("loss")), "").alias("learned"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    whole = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        _hex(whole).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        _hex(F.col("learned")).alias("loss_sha256"),
        "formatted_chars",
    )


@query("op10_byte_bpe")
def op10_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return tokenized(spark, docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def tokenized(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    """``doc_id`` with the digests of the ids and of the bytes that they decode to."""
    vocabulary = bpe.share(spark, bpe.read_ranks(path, public_tokenizers.PATTERN))
    ids = docs.select("doc_id", bpe.encode(F.col("text"), vocabulary).alias("ids"))
    both = ids.select("doc_id", "ids", bpe.decode(F.col("ids"), vocabulary).alias("data"))
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        _hex(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"),
        _hex(F.col("data")).alias("decoded_sha256"),
    )


@query("op11_html_extraction")
def op11_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    model = extraction.share(spark, extraction.train())
    pages = table(spark, folder, "pages")
    read = pages.select("page_id", "url", extraction.main_text(F.col("html"), model).alias("text"))
    return read.withColumn("n_chars", F.length("text").cast("long"))


_TERMS_SQL = rf"""WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
    w AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
    c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT id) AS documents FROM w GROUP BY ALL),
    k AS (SELECT lang, term, sum(n) AS everywhere FROM c GROUP BY ALL HAVING sum(documents) >= {divergence.LEAST_DOCUMENTS}),
    v AS (SELECT lang, count(*) AS v, sum(everywhere) AS whole FROM k GROUP BY lang),
    t AS (SELECT c.* FROM c SEMI JOIN k USING (lang, term)),
    s AS (SELECT lang, source, sum(n) AS n FROM t GROUP BY ALL),
    g AS (SELECT o.lang, o.source, coalesce(v.v, 0) AS v, coalesce(s.n, 0) AS n, whole
        FROM (SELECT DISTINCT lang, source FROM d) o LEFT JOIN v USING (lang) LEFT JOIN s USING (lang, source)),
    p AS (SELECT g.lang, g.source, k.term, coalesce(t.n, 0) AS n,
        1 + CAST({divergence.PARTS} AS HUGEINT) * (coalesce(t.n, 0) + 5) // (g.n + 5 * g.v) AS p,
        1 + CAST({divergence.PARTS} AS HUGEINT) * (everywhere + 5) // (whole + 5 * g.v) AS q
        FROM g JOIN k USING (lang) LEFT JOIN t USING (lang, source, term)),
    f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
        FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL)"""


@query(
    "op12_source_divergence",
    f"""{_TERMS_SQL}
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (
            SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (
                SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
                FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
                LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
                UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q))
        WHERE part = 'pair' OR rank <= {divergence.TOP}""",
)
def op12_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.divergence(table(spark, folder, "documents"))


@query("op13_tokenizer_alignment")
def op13_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    files = alignment.share(
        spark, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    )
    return alignment.align(table(spark, folder, "documents"), files)


@query("pipeline")
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)
