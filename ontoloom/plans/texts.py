"""Queries on documents and answers, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ontoloom.functions.text import answer_tokens
from ontoloom.operators import chunks, mining
from ontoloom.session import table

SP = r"[\s\p{Z}]"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{SP}+|{SP}+$', '', 'g')"


def docs(spark, d):
    return table(spark, d, "documents")


def _chunk(strategy):
    return lambda spark, d: chunks.chunk(docs(spark, d), strategy).select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.md5("chunk").alias("chunk_md5"))


_SEC = f"list_filter(list_transform(string_split(regexp_replace(text, '\\n(#{{1,6}}\\s)', chr(1) || '\\1', 'g'), chr(1)), lambda x: {_trim('x')}), lambda x: x <> '')"
_PAR = f"list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: {_trim('x')}), lambda x: x <> '')"
_WIN = "case when length(text) > 0 then list_transform(range(0, greatest(0, ceil((length(text) - 800) / 600.0))::bigint + 1), lambda i: substring(text, i * 600 + 1, 800)) else [] end"
_AUTO = f"case when regexp_matches(text, '(?m)^#{{1,6}}\\s') and len({_SEC}) > 1 then {_SEC} when len({_PAR}) > 1 then {_PAR} else {_WIN} end"


def _chunk_sql(expr: str) -> str:
    return f"with c as (select doc_id, {expr} l from documents where text is not null) select doc_id, i - 1 as pos, md5(l[i]) as chunk_md5 from (select doc_id, l, unnest(range(1, len(l) + 1)) i from c)"


_HEAD = "regexp_matches(chr(10) || text, '\\n#{1,6}[ \\t]+[^\\n]')"
_MARK = "regexp_replace(chr(10) || text, '\\n(#{1,6})[ \\t]+([^\\n]+)', chr(1) || '\\1' || chr(2) || '\\2' || chr(3), 'g')"
_SECTIONS = f"""with p as (select doc_id, string_split({_MARK}, chr(1)) l from documents where text is not null),
x as (select doc_id, unnest(range(2, len(l) + 1)) i, l from p)
select doc_id, i - 1 as pos, length(string_split(l[i], chr(2))[1]) as level,
 {_trim("string_split(string_split(l[i], chr(2))[-1], chr(3))[1]")} as title, md5({_trim("string_split(string_split(l[i], chr(2))[-1], chr(3))[-1]")}) as content_md5 from x
union all select doc_id, 1, 0, '', md5({_trim('text')}) from documents where text is not null and not {_HEAD}"""


def sections(spark, d):
    return chunks.sections(docs(spark, d)).select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.col("level").cast("bigint").alias("level"), "title", F.md5("content").alias("content_md5"))


_QUALITY = f"""select doc_id, coalesce(length(text), 0) as length, coalesce(length(text), 0) > 100 as has_content, coalesce({_HEAD}, false) as has_structure,
 round(coalesce((length(regexp_replace(text, '[\\p{{C}}\\p{{Z}}]', '', 'g')) + length(regexp_replace(text, '[^ \\t\\n\\r]', '', 'g'))) / nullif(length(text), 0)::double, 0), 6) as printable_ratio from documents"""
_SCORE = f"""select doc_id, least(10, case when n > 500 then 4 when n > 100 then 2 else 0 end + case when h then 3 else 0 end + case when n > 2000 then 2 else 0 end + case when n > 5000 then 1 else 0 end) as score
 from (select doc_id, coalesce(length(text), 0) n, coalesce({_HEAD}, false) h from documents)"""


def _finds_sql(pattern: str, *groups: int) -> str:
    """SQL of (doc_id, g1, ...) for each match."""
    p = pattern.replace("'", "''")
    got = ", ".join(f"regexp_extract_all(text, '{p}', {g}) l{i}" for i, g in enumerate(groups, 1))
    cols = ", ".join(_trim(f"l{i}[k]") + f" g{i}" for i in range(1, len(groups) + 1))
    return f"(select doc_id, {cols} from (select *, unnest(range(1, len(l1) + 1)) k from (select doc_id, {got} from documents where text is not null)))"


_GENERIC = ", ".join(f"'{w}'" for w in mining.GENERIC)
_PHRASES = f"""with r as (select doc_id, unnest(regexp_extract_all(text, '([一-龥]{{2,6}})', 1)) term from documents where text is not null),
c as (select doc_id, term, count(*) n from r where term not in ({_GENERIC}) and not regexp_matches(term, '[{mining.STOP_CHARS}]') group by all),
k as (select *, row_number() over (partition by doc_id order by n desc, term) rk, count(*) over (partition by doc_id) dt from c)
select doc_id, term, n, round(least(0.4 + 0.1 * n, 0.8), 6) as confidence from k where rk <= 50 and (n >= 2 or dt <= 20)"""
_HEARST = "select child, parent, max(confidence) as confidence, count(distinct doc_id) as n_docs from (" + " union all ".join(f"select doc_id, g1 child, g2 parent, {c}::double confidence from {_finds_sql(p, a, b)}" for p, a, b, c, _ in mining.HEARST.values()) + ") where length(child) >= 2 and length(parent) >= 2 and child <> parent and parent not like 'kind of %' group by child, parent"
_TRIGGERS = f"""select name, event_type, event_detail, condition_expression, action_detail, count(distinct doc_id) as n_docs from (
 select doc_id, '超时' || g3 name, 'time_based' event_type, '超过' || g1 event_detail, '未' || g2 condition_expression, g3 action_detail from {_finds_sql(mining.TIMEOUT, 1, 2, 3)}
 union all select doc_id, g1 || '后' || g2, 'status_transition', g1 || '完成', g1 || '成功', g2 from {_finds_sql(mining.POST_ACTION, 1, 2)}) group by all"""
_OPS = f"select g2 as name, min(g1) as actor, count(*) as n from {_finds_sql(mining.OPERATION, 1, 2)} where length(g2) >= 2 group by g2"
_FLOWS = f"""select array_to_string(s, '→') as flow, max(len(s)) as n_steps, max(s[1]) as first_step, max(s[-1]) as last_step, count(distinct doc_id) as n_docs
 from (select doc_id, list_transform(string_split_regex(g1, '[ ]*(?:->|→)[ ]*'), lambda x: {_trim('x')}) s from {_finds_sql(mining.FLOW, 1)}) group by 1"""
_PERM = f"""with f as (select g1 subject, g2 action, 'deny' effect from {_finds_sql(mining.PERMISSION['deny'], 1, 2)} union all select g1, g2, 'allow' from {_finds_sql(mining.PERMISSION['allow'], 1, 2)}),
a as (select *, list_filter([case when regexp_matches(action, '查看|查询|浏览|查') then 'read' end, case when regexp_matches(action, '修改|更新|编辑|改') then 'write' end, case when regexp_matches(action, '删除|移除') then 'delete' end], lambda x: x is not null) v from f where subject in ('管理员', '客服人员', '普通客户', '企业客户', '仓库主管', '财务人员', '代理商', 'VIP客户'))
select subject, effect, action, case when len(v) = 0 then 'execute' else array_to_string(v, '|') end as actions, count(*) as n from a group by all"""
_DERIV = f"select g1 as target, g2 as formula, count(distinct doc_id) as n_docs from {_finds_sql(mining.DERIVATION, 1, 2)} group by all"
_LIMITS = f"select subject, kind, bound, count(distinct doc_id) as n_docs from (select doc_id, g1 subject, 'digits' kind, try_cast(g2 as double) bound from {_finds_sql(mining.LIMIT_DIGITS, 1, 2)} union all select doc_id, g1, 'max_length', try_cast(g2 as double) from {_finds_sql(mining.LIMIT_LENGTH, 1, 2)} union all select doc_id, g1, 'min_value', try_cast(g2 as double) from {_finds_sql(mining.LIMIT_LEAST, 1, 2)}) group by all"

#: Subjects of the sample permissions.
SUBJECTS = ["管理员", "客服人员", "普通客户", "企业客户", "仓库主管", "财务人员", "代理商", "VIP客户"]


def permissions(spark, d):
    return mining.permissions(docs(spark, d), spark.createDataFrame([(s,) for s in SUBJECTS], "name string"))


def answer_scores(spark, d):
    """Coverage of the truth's tokens by each available answer, weighted by length, plain, and the answer's unsupported share."""
    qa = table(spark, d, "qa_dataset").groupBy("id").agg(F.max("ground_truth").alias("truth"), F.max("question").alias("question"))
    r = table(spark, d, "condition_result").where("available").groupBy("result_id").agg(F.max("qa_id").alias("id"), F.max("condition_name").alias("condition_name"), F.max("answer").alias("answer"))
    j = r.join(qa, "id").withColumn("t", answer_tokens(F.coalesce("truth", F.lit("")))).withColumn("a", answer_tokens(F.coalesce("answer", F.lit("")))).withColumn("q", answer_tokens(F.coalesce("question", F.lit(""))))
    both = F.array_intersect("t", "a")
    weight = lambda x: F.aggregate(x, F.lit(0), lambda acc, w: acc + F.least(F.length(w), F.lit(4)))
    ratio = lambda a, b: F.round(F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0)), 3)
    loose = F.array_except("a", F.array_union("t", "q"))
    return j.select("result_id", "condition_name", ratio(weight(both), weight(F.col("t"))).alias("accuracy"), ratio(F.size(both), F.size("t")).alias("completeness"), ratio(F.size(loose), F.size("a")).alias("hallucination"))


def eval_summary(spark, d):
    return answer_scores(spark, d).groupBy("condition_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("accuracy"), 4).alias("accuracy"), F.round(F.avg("completeness"), 4).alias("completeness"), F.round(F.avg("hallucination"), 4).alias("hallucination"))


def eval_best(spark, d):
    """Per category the condition of the highest mean accuracy; ties go to the first by name."""
    qa = table(spark, d, "qa_dataset").groupBy("id").agg(F.max("category").alias("category"))
    r = table(spark, d, "condition_result").groupBy("result_id").agg(F.max("qa_id").alias("id"))
    s = answer_scores(spark, d).join(r, "result_id").join(qa, "id").groupBy("category", "condition_name").agg(F.round(F.avg("accuracy"), 4).alias("accuracy"))
    best = s.groupBy("category").agg(F.max("accuracy").alias("best_accuracy"), F.min_by("condition_name", F.struct(-F.col("accuracy"), F.col("condition_name"))).alias("best_condition"))
    return best


def _tok(x: str) -> str:
    han = f"regexp_replace(lower({x}), '[^一-鿿]', '', 'g')"
    return f"list_distinct(list_concat(list_filter(regexp_extract_all(lower({x}), '([a-z0-9_]+)', 1), lambda w: length(w) >= 2), list_transform(range(1, greatest(length({han}), 1)), lambda i: substring({han}, i, 2))))"


_SCORES = f"""with qa as (select id, max(ground_truth) truth, max(question) question from qa_dataset group by id),
r as (select result_id, max(qa_id) id, max(condition_name) condition_name, max(answer) answer from condition_result where available group by result_id),
j as (select result_id, condition_name, category_key, {_tok("coalesce(truth, '')")} t, {_tok("coalesce(answer, '')")} a, {_tok("coalesce(question, '')")} q from (select r.*, truth, question, r.id category_key from r join qa using (id))),
k as (select *, list_intersect(t, a) b, list_filter(a, lambda x: not list_contains(t, x) and not list_contains(q, x)) l from j),
s as (select result_id, condition_name, category_key, round(coalesce(list_sum(list_transform(b, lambda w: least(length(w), 4)))::double / nullif(list_sum(list_transform(t, lambda w: least(length(w), 4))), 0), 0), 3) accuracy,
 round(coalesce(len(b)::double / nullif(len(t), 0), 0), 3) completeness, round(coalesce(len(l)::double / nullif(len(a), 0), 0), 3) hallucination from k)
"""

QUERIES = {
    "chunk_sections": _chunk("sections"),
    "chunk_paragraph": _chunk("paragraphs"),
    "chunk_window": _chunk("window"),
    "chunk_auto": _chunk("auto"),
    "section_extract": sections,
    "doc_quality": lambda s, d: chunks.quality(docs(s, d)),
    "doc_score": lambda s, d: chunks.score(docs(s, d)),
    "cn_phrases": lambda s, d: mining.phrases(docs(s, d)),
    "text_concepts": lambda s, d: mining.concepts(mining.phrases(docs(s, d))),
    "hearst": lambda s, d: mining.hearst(docs(s, d)),
    "triggers": lambda s, d: mining.triggers(docs(s, d)),
    "ops_text": lambda s, d: mining.operations(docs(s, d)),
    "flows": lambda s, d: mining.flows(docs(s, d)),
    "perm_rules": permissions,
    "derive_text": lambda s, d: mining.derivations(docs(s, d)),
    "valid_text": lambda s, d: mining.limits(docs(s, d)),
    "exceptions": lambda s, d: mining.exceptions(mining.triggers(docs(s, d)), ("取消", "关闭")),
    "answer_score": answer_scores,
    "eval_summary": eval_summary,
    "eval_best": eval_best,
}
ORACLE = {
    "chunk_sections": _chunk_sql(_SEC),
    "chunk_paragraph": _chunk_sql(_PAR),
    "chunk_window": _chunk_sql(_WIN),
    "chunk_auto": _chunk_sql(_AUTO),
    "section_extract": _SECTIONS,
    "doc_quality": _QUALITY,
    "doc_score": _SCORE,
    "cn_phrases": _PHRASES,
    "text_concepts": f"select term as name, max(confidence) as confidence, sum(n)::bigint as instance_count from ({_PHRASES}) group by term",
    "hearst": _HEARST,
    "triggers": _TRIGGERS,
    "ops_text": _OPS,
    "flows": _FLOWS,
    "perm_rules": _PERM,
    "derive_text": _DERIV,
    "valid_text": _LIMITS,
    "exceptions": f"select * from ({_TRIGGERS}) where event_type = 'time_based' and (action_detail like '%取消%' or action_detail like '%关闭%')",
    "answer_score": _SCORES + "select result_id, condition_name, accuracy, completeness, hallucination from s",
    "eval_summary": _SCORES + "select condition_name, count(*) as n, round(avg(accuracy), 4) as accuracy, round(avg(completeness), 4) as completeness, round(avg(hallucination), 4) as hallucination from s group by 1",
    "eval_best": _SCORES + ", c as (select category, condition_name, round(avg(accuracy), 4) accuracy from s join (select id, max(category) category from qa_dataset group by id) q on q.id = category_key group by 1, 2) select category, max(accuracy) as best_accuracy, arg_min(condition_name, (-accuracy, condition_name)) as best_condition from c group by category",
}
