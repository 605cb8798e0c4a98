"""The queries opN_<name> over the driver's tables, and the SQL that some of them can be checked with."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontaminate, divergence, fingerprints, language_id, line_dedup, lm_score, mixing, near_dedup, phrases, secrets, sharding, toxicity


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_neighbours(documents(spark, sf_dir))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(documents(spark, sf_dir))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(documents(spark, sf_dir)).select("doc_id", "text", "n_lines", "n_deleted")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict(documents(spark, sf_dir))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(documents(spark, sf_dir))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(documents(spark, sf_dir))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


# -- parts of the results that SQL can say, and invariants ----------------------------------------------------------
def sharding_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: rows, bytes, whether slots are gapless in every shard, whether shards are in range, and whether the law of
    equal bytes holds: no shard is further over or under an equal share than the heaviest virtual slot weighs."""
    rows = op1_sharding(spark, sf_dir)
    each = rows.groupBy("shard").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min("slot").alias("low"), F.max("slot").alias("high"), F.countDistinct("slot").alias("slots"))
    heaviest = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes")).agg(F.max("bytes").alias("heaviest"))
    gapless = F.bool_and((F.col("low") == 0) & (F.col("high") == F.col("n") - 1) & (F.col("slots") == F.col("n")))
    share = F.sum("bytes") / 40
    total = each.agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), gapless.alias("gapless"), (F.min("shard") >= 0).alias("low"), (F.max("shard") < 40).alias("high"), (F.max("bytes") - share).alias("over"), (share - F.min("bytes")).alias("under"))
    return total.crossJoin(heaviest).select("n", "bytes", "gapless", "low", "high", (F.greatest("over", "under") <= F.col("heaviest")).alias("even"))  # one row each


def fingerprint_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_lm_score(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and targets per document, whether it is taken twice at most, and whether its source's words meet the target."""
    each = op12_mixing(spark, sf_dir)
    sums = each.groupBy(F.col("source").alias("of")).agg(F.sum("taken").alias("sum"))
    near = F.abs(F.col("sum") - F.col("target")) <= 0.5
    return each.join(sums, F.col("source").eqNullSafe(F.col("of"))).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), (F.col("taken") <= 2 * F.col("size")).alias("within"), near.alias("near"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_fingerprints": op2_fingerprints,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_secrets": op4_secrets,
    "op5_lm_score": op5_lm_score,
    "op6_toxicity": op6_toxicity,
    "op7_line_dedup": op7_line_dedup,
    "op8_decontaminate": op8_decontaminate,
    "op9_language_id": op9_language_id,
    "op10_near_dedup": op10_near_dedup,
    "op11_phrases": op11_phrases,
    "op12_mixing": op12_mixing,
    "op13_divergence": op13_divergence,
    "mixing_targets": mixing_targets,
    "sharding_totals": sharding_totals,
    "fingerprint_edits": fingerprint_edits,
    "secret_counts": secret_counts,
    "lm_base": lm_base,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+')"
#: crc32 by its table of 256 entries, over the decimal digits of an id.
_CRC_TABLE = """crc as (with recursive r(i, k, v) as (select i, 0, i::bigint from range(256) t(i) union all select i, k + 1, xor(v >> 1, 3988292384 * (v & 1)) from r where k < 8) select list(v order by i) as t from r where k = 8)"""
_CRC = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"

ORACLE_SQL: dict[str, str] = {
    "sharding_totals": "select count(*) as n, sum(octet_length(encode(coalesce(text, ''))) + 16)::bigint as bytes, true as gapless, true as low, true as high, true as even from documents",
    "fingerprint_edits": """with d as (select doc_id, coalesce(text, '') as x from documents), o as (select doc_id, x, coalesce(lead(x) over (order by doc_id desc), first_value(x) over (order by doc_id desc)) as y from d)
        select doc_id, length(x) as n_chars, sha256(substring(x, 1, length(x) - length(x) // 3) || substring(y, 1, length(x) // 3)) as edited_sha256 from o""",
    "secret_counts": r"""select doc_id, len(list_filter(regexp_extract_all(coalesce(text, ''), '(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["\x27]?\x20*[:=]\x20*["\x27]?([A-Za-z0-9+/_.=-]+)', 1), lambda x: length(x) >= 6)) as n_assign,
        len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) as n_access, len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 24)) as n_hex from documents""",
    "lm_base": f"""with {_CRC_TABLE}, d as (select doc_id, {_CRC} % 7 = 2 as held_out, list_append({_WORDS}, chr(10)) as w from documents cross join crc),
        e as (select doc_id, held_out, unnest(w) as w from d), c as (select w, count(*) as c from e where not held_out group by w), s as (select sum(c)::bigint as n, count(*) as v from c)
        select doc_id, held_out, count(*) as n_tokens, count(c) as n_known, any_value(n) as train_tokens, round(sum(log10((coalesce(c, 0) + 1) / (n + v + 1)::double)), 4) as base_score
        from e left join c using (w) cross join s group by doc_id, held_out""",
    "op7_line_dedup": r"""with raw as (select doc_id, text, string_split(text, chr(10)) as l from documents), every as (select doc_id, unnest(l) as l, generate_subscripts(l, 1) - 1 as line from raw where text is not null),
        s as (select doc_id, line, regexp_replace(l, '[\x20\x09-\x0D]+$', '') as x, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) as words from every),
        o as (select doc_id, line, x, words, row_number() over w - 1 as q, sum(words) over w as upto, sum(words) over w - words as before from s where words > 0 window w as (partition by doc_id order by line)),
        runs as (select distinct a.doc_id, a.q as a, b.q as b from o a join o b on a.doc_id = b.doc_id and b.q between a.q and a.q + 49 and b.upto - a.before >= 50 and (b.before - a.before < 50 or b.upto - a.upto < 50)),
        whole as (select doc_id, list(x order by q) as x from o group by doc_id), named as (select doc_id, a, b, md5(array_to_string(x[a + 1 : b + 1], chr(10))) as name from runs join whole using (doc_id)),
        placed as (select doc_id, a, b, first_value(doc_id) over w as first_doc, first_value(a) over w as first_a, first_value(b) over w as first_b from named window w as (partition by name order by doc_id, a)),
        gone as (select distinct p.doc_id, o.line from placed p join o on o.doc_id = p.doc_id and o.q between case when p.doc_id = first_doc then greatest(p.a, first_b + 1) else p.a end and p.b where (p.doc_id, p.a) != (first_doc, first_a)),
        kept as (select e.doc_id, string_agg(l, chr(10) order by e.line) filter (where g.line is null) as text, count(g.line) as n_deleted, count(*) as n_lines from every e left join gone g on e.doc_id = g.doc_id and e.line = g.line group by e.doc_id)
        select d.doc_id, case when n_deleted > 0 then coalesce(k.text, '') else d.text end as text, coalesce(n_lines, 0) as n_lines, coalesce(n_deleted, 0) as n_deleted from documents d left join kept k on d.doc_id = k.doc_id""",
    "op11_phrases": f"""with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) as p from documents), w as (select lang, regexp_extract_all(p, '[^\\x20\\x09]+') as w from p),
        g as (select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) as phrase from w cross join range(1, 5) t(k)),
        f as (select lang, k, phrase, count(*) as f from g group by all having count(*) >= 30), n as (select lang, sum(len(w))::bigint as n from w group by lang),
        c as (select lang, k, phrase, f as a, unnest(range(1, k)) as cut, string_split(phrase, ' ') as s from f where k > 1),
        cuts as (select c.lang, c.k, c.phrase, a, cut, l.f as l, r.f as r, (2000000::hugeint * a // (l.f + r.f))::bigint as score from c join f l on l.lang = c.lang and l.phrase = array_to_string(s[: cut], ' ') join f r on r.lang = c.lang and r.phrase = array_to_string(s[cut + 1 :], ' ')),
        best as (select *, row_number() over (partition by lang, phrase order by score, cut) as place from cuts),
        kept as (select * from best b where place = 1 and not exists (select 1 from f where f.lang = b.lang and f.k > b.k and contains(' ' || f.phrase || ' ', ' ' || b.phrase || ' ') and 100::hugeint * f.f >= 80::hugeint * b.a)),
        ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
        select lang, rank, phrase, a, l, r, n, score from ranked join n using (lang) where rank <= 2000""",
    "mixing_targets": r"""with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size from documents),
        s as (select source, sum(size)::bigint as source_size, [5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1] as w from d group by source),
        o as (select sum(2 * source_size) over o as held, sum(w) over () - sum(w) over o as rest, sum(source_size) over () * 1.5 as goal from s window o as (order by source_size / w, source nulls last)),
        -- the level is the highest that any first few sources, stopped at their caps, leave to the others
        l as (select greatest(max(goal) / (select sum(w) from s), max((goal - held) / rest) filter (where rest > 0)) as level from o)
        select doc_id, size, source_size, round(least(2 * source_size, w * level)::double, 3) as target, true as within, true as near from d join s on d.source is not distinct from s.source cross join l""",
    "op13_divergence": r"""with d as (select row_number() over () as i, coalesce(lang, '') as lang, coalesce(source, '') as source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as x from documents),
        t as (select i, lang, source, unnest(regexp_extract_all(x, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d), c as (select lang, source, term, count(*) as n from t group by all),
        k as (select lang, term, count(*) as n from t group by all having count(distinct i) >= 10), g as (select distinct lang, source from d),
        cell as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, k.n as lang_n from g join k on g.lang = k.lang left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
        p as (select *, 1 + 1000000000::hugeint * (n + 2) // (sum(n) over g + 2 * count(*) over g) as p, 1 + 1000000000::hugeint * (lang_n + 2) // (sum(lang_n) over g + 2 * count(*) over g) as q from cell window g as (partition by lang, source)),
        total as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source != b.source group by all),
        pair as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source != b.source left join total on total.lang = a.lang and total.source = a.source and total.item = b.source),
        term as (select lang, source, 'term' as part, term as item, ((p - q) * (p - q) // (p + q))::bigint as value from p where n > 0 and p > q),
        ranked as (select *, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank from (select * from pair union all select * from term))
        select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 10""",
    "op10_near_dedup": f"""with recursive d as (select doc_id, {_WORDS} as w from documents),
        s as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) end) as s from d),
        e as (select doc_id, len(s) as n, unnest(s) as x from s), pairs as (select a.doc_id as u, b.doc_id as v, count(*) as c, any_value(a.n) as m, any_value(b.n) as n from e a join e b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
        links as (select u, v from pairs where 100 * c >= 75 * (m + n - c)), ways as (select u, v from links union all select v, u from links),
        reach(doc_id, root) as (select doc_id, doc_id from documents union select b.v, r.root from reach r join ways b on b.u = r.doc_id where r.root < b.v)
        select s.doc_id, len(s.s) as n_shingles, r.root as component_id, r.root = s.doc_id as kept from s join (select doc_id, min(root) as root from reach group by doc_id) r on s.doc_id = r.doc_id""",
}
