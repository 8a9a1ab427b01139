"""Pattern mining in texts: concepts, is-a links, triggers, operations, flows, permissions, derivations, limits.

Patterns use explicit character classes, so both Java's and RE2's engines find the same matches.  Null texts yield no
rows; a row per distinct find and document, without repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ontoloom.functions.text import HAN, WORD, captures, trim

#: Words too general for concepts, and characters of function words.
GENERIC = "系统 方法 数据 信息 记录 内容 事物 对象 实体 类型 方式".split()
STOP_CHARS = "的了是在和与或也都但而如为对从到向由以于按据"

_T = r"[^，。；、！？：,.;!?:\n]"
#: Is-a patterns with the places of child and parent, confidence and the cue that any match holds; the tail runs to the next punctuation.
HEARST = {
    "cn_kind": (rf"({_T}{{2,20}}?)是一(?:种|个|类)({_T}{{2,20}})", 1, 2, 0.95, "是一"),
    "cn_belongs": (rf"({_T}{{2,20}}?)属于({_T}{{2,20}}?)(?:范畴|类别|大类)", 1, 2, 0.95, "属于"),
    "cn_subclass": (rf"({_T}{{2,20}}?)是({_T}{{2,20}}?)的子类", 1, 2, 0.95, "的子类"),
    "cn_one_of": (rf"({_T}{{2,20}}?)是({_T}{{2,20}}?)的一(?:种|个|类)", 1, 2, 0.95, "的一"),
    "cn_includes": (rf"({_T}{{2,20}}?)包括({_T}{{2,20}})", 2, 1, 0.95, "包括"),
    "cn_divides": (rf"({_T}{{2,20}}?)分为({_T}{{2,20}})", 2, 1, 0.95, "分为"),
    "en_is_a": (r"([A-Za-z][A-Za-z0-9_ ]{1,40}?) is an? ([A-Za-z][A-Za-z0-9_ ]{1,40})", 1, 2, 0.90, " is a"),
    "en_kind_of": (r"([A-Za-z][A-Za-z0-9_ ]{1,40}?) is an? kind of ([A-Za-z][A-Za-z0-9_ ]{1,40})", 1, 2, 0.90, " kind of "),
    "en_such_as": (r"([A-Za-z][A-Za-z0-9_ ]{1,40}?) such as ([A-Za-z][A-Za-z0-9_ ]{1,40})", 2, 1, 0.90, " such as "),
    "en_including": (r"([A-Za-z][A-Za-z0-9_ ]{1,40}?) including ([A-Za-z][A-Za-z0-9_ ]{1,40})", 2, 1, 0.90, " including "),
}
#: The patterns of triggers, operations, flows, permissions, derivations and limits.
TIMEOUT = rf"如果[^，。]*?在(\d+[小时天分钟]+)内未({WORD}+)[，,][^\n]*?[将则]自动({WORD}+)"
POST_ACTION = rf"({WORD}+)(?:成功|完成)后[，,]{{1}}[ ]*系统[会将]?(?:自动)?({WORD}+)"
OPERATION = rf"({HAN}+)(?:可以|能够|可)({HAN}{{2,8}})(?:[、，])"
FLOW = rf"({WORD}+(?:[ ]*(?:->|→)[ ]*{WORD}+)+)"
PERMISSION = {"deny": rf"({WORD}+?)不(?:能|可以|可)({HAN}+)", "allow": rf"({WORD}+?)(?:可以|有权)({HAN}+)"}
DERIVATION = rf"({HAN}{{2,12}})[ ]*[=＝][ ]*({HAN}{{2,12}}(?:[ ]*[+\-×÷*/][ ]*{HAN}{{2,12}})+)"
LIMIT_DIGITS = rf"({HAN}+)必须[为是](\d+)位"
LIMIT_LEAST = rf"({HAN}+)必须[大≥]于?[等=]?(\d+(?:\.\d+)?)"
LIMIT_LENGTH = rf"({HAN}+)不超过(\d+)个字符"


def _finds(docs: DataFrame, pattern: str, *groups: int) -> DataFrame:
    return docs.where("text is not null").select("doc_id", F.explode(captures("text", pattern, *groups)).alias("m")).select("doc_id", *[trim(F.col(f"m.g{i}")).alias(f"g{i}") for i in range(1, len(groups) + 1)])


def phrases(docs: DataFrame, top: int = 50) -> DataFrame:
    """(doc_id, term, n, confidence): runs of 2 to 6 ideographs, the `top` most frequent of a document, those found twice or all of few."""
    runs = docs.where("text is not null").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"({HAN}{{2,6}})"), F.lit(1))).alias("term"))
    kept = runs.where(~F.col("term").isin(GENERIC) & ~F.col("term").rlike(f"[{STOP_CHARS}]"))
    counts = kept.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("doc_id")
    ranked = counts.withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), "term"))).withColumn("distinct_terms", F.count(F.lit(1)).over(w))
    return ranked.where((F.col("rank") <= top) & ((F.col("n") >= 2) | (F.col("distinct_terms") <= 20))).select("doc_id", "term", "n", F.round(F.least(0.4 + 0.1 * F.col("n"), F.lit(0.8)), 6).alias("confidence"))


def concepts(found: DataFrame) -> DataFrame:
    """(name, confidence, instance_count): terms over all documents, the highest confidence holding."""
    return found.groupBy(F.col("term").alias("name")).agg(F.max("confidence").alias("confidence"), F.sum("n").alias("instance_count"))


def hearst(docs: DataFrame, patterns: dict = HEARST) -> DataFrame:
    """(child, parent, confidence, n_docs) over all patterns; links of a name to itself are left out.

    No match crosses punctuation, so texts are cut there first and only pieces with a pattern's cue are searched, all patterns in one scan."""
    piece = F.col("piece")
    none = F.array().cast("array<struct<child:string,parent:string,confidence:double>>")
    found = []

    def link(conf: float):
        return lambda m: F.struct(trim(m["g1"]).alias("child"), trim(m["g2"]).alias("parent"), F.lit(conf).alias("confidence"))

    for p, child, parent, conf, cue in patterns.values():
        found.append(F.when(F.contains(piece, F.lit(cue)), F.transform(captures(piece, p, child, parent), link(conf))).otherwise(none))
    any_cue = "|".join(x[4] for x in patterns.values())
    pieces = docs.where("text is not null").select("doc_id", F.explode(F.split("text", _T.replace("[^", "[")).alias("pieces")).alias("piece")).where(piece.rlike(any_cue))
    links = pieces.select("doc_id", F.explode(F.concat(*found)).alias("m")).select("doc_id", "m.*")
    good = links.where("length(child) >= 2 and length(parent) >= 2 and child != parent and parent not like 'kind of %'")
    return good.groupBy("child", "parent").agg(F.max("confidence").alias("confidence"), F.count_distinct("doc_id").alias("n_docs"))


def triggers(docs: DataFrame) -> DataFrame:
    """(name, event_type, event_detail, condition_expression, action_detail, n_docs)."""
    late = _finds(docs, TIMEOUT, 1, 2, 3).select("doc_id", F.concat(F.lit("超时"), "g3").alias("name"), F.lit("time_based").alias("event_type"), F.concat(F.lit("超过"), "g1").alias("event_detail"), F.concat(F.lit("未"), "g2").alias("condition_expression"), F.col("g3").alias("action_detail"))
    after = _finds(docs, POST_ACTION, 1, 2).select("doc_id", F.concat("g1", F.lit("后"), "g2").alias("name"), F.lit("status_transition").alias("event_type"), F.concat("g1", F.lit("完成")).alias("event_detail"), F.concat("g1", F.lit("成功")).alias("condition_expression"), F.col("g2").alias("action_detail"))
    keys = ["name", "event_type", "event_detail", "condition_expression", "action_detail"]
    return late.unionByName(after).groupBy(*keys).agg(F.count_distinct("doc_id").alias("n_docs"))


def exceptions(found: DataFrame, words: tuple[str, ...] = ("取消",)) -> DataFrame:
    """Handlers of exceptions: time-out triggers whose action has one of the words."""
    return found.where("event_type = 'time_based'").where(F.col("action_detail").rlike("|".join(words)))


def operations(docs: DataFrame) -> DataFrame:
    """(name, actor, n): actions that an actor may take, the least actor of those that state it."""
    return _finds(docs, OPERATION, 1, 2).where("length(g2) >= 2").groupBy(F.col("g2").alias("name")).agg(F.min("g1").alias("actor"), F.count(F.lit(1)).alias("n"))


def flows(docs: DataFrame) -> DataFrame:
    """(flow, n_steps, first_step, last_step, n_docs): chains joined by arrows."""
    steps = F.transform(F.split("g1", "[ ]*(?:->|→)[ ]*"), trim)
    f = _finds(docs, FLOW, 1).select("doc_id", steps.alias("steps"))
    return f.groupBy(F.array_join("steps", "→").alias("flow")).agg(F.max(F.size("steps")).cast("bigint").alias("n_steps"), F.max(F.get("steps", F.lit(0))).alias("first_step"), F.max(F.element_at("steps", -1)).alias("last_step"), F.count_distinct("doc_id").alias("n_docs"))


def flow_steps(found: DataFrame) -> DataFrame:
    """(flow, step_order, operation)."""
    return found.select("flow", F.posexplode(F.split("flow", "→")).alias("step_order", "operation"))


def permissions(docs: DataFrame, subjects: DataFrame) -> DataFrame:
    """(subject, effect, action, actions, n): sentences about known subjects (column name); actions are read, write, delete or execute."""
    out = None
    for effect, p in PERMISSION.items():
        f = _finds(docs, p, 1, 2).select(F.col("g1").alias("subject"), F.col("g2").alias("action"), F.lit(effect).alias("effect"))
        out = f if out is None else out.unionByName(f)
    verbs = F.array_compact(F.array(F.when(F.col("action").rlike("查看|查询|浏览|查"), "read"), F.when(F.col("action").rlike("修改|更新|编辑|改"), "write"), F.when(F.col("action").rlike("删除|移除"), "delete")))
    known = out.join(subjects.select(F.col("name").alias("subject")).distinct(), "subject", "left_semi")
    return known.withColumn("actions", F.when(F.size(verbs) == 0, "execute").otherwise(F.array_join(verbs, "|"))).groupBy("subject", "effect", "action", "actions").agg(F.count(F.lit(1)).alias("n"))


def derivations(docs: DataFrame) -> DataFrame:
    """(target, formula, n_docs): a quantity said to be computed from others."""
    return _finds(docs, DERIVATION, 1, 2).groupBy(F.col("g1").alias("target"), F.col("g2").alias("formula")).agg(F.count_distinct("doc_id").alias("n_docs"))


def limits(docs: DataFrame) -> DataFrame:
    """(subject, kind, bound, n_docs): digits a value must have, characters it may have at most, numbers it must exceed or reach."""
    a = _finds(docs, LIMIT_DIGITS, 1, 2).withColumn("kind", F.lit("digits"))
    b = _finds(docs, LIMIT_LENGTH, 1, 2).withColumn("kind", F.lit("max_length"))
    c = _finds(docs, LIMIT_LEAST, 1, 2).withColumn("kind", F.lit("min_value"))
    return a.unionByName(b).unionByName(c).groupBy(F.col("g1").alias("subject"), "kind", F.expr("try_cast(g2 as double)").alias("bound")).agg(F.count_distinct("doc_id").alias("n_docs"))


#: Sequences that name a role.
ROLES = rf"((?:VIP)?{HAN}{{0,4}}(?:管理员|管理人|客户|主管|人员|代理商))"


def subjects(docs: DataFrame, configured: DataFrame) -> DataFrame:
    """(name, origin, parent, n_docs): configured subjects (name, parent; an unknown parent is dropped) and roles found in texts that aren't configured, of 2 to 10 characters."""
    names = configured.select(F.col("name").alias("parent"), F.lit(True).alias("known")).distinct()
    conf = configured.select("name", "parent").join(names, "parent", "left").select("name", F.lit("config").alias("origin"), F.when(F.col("known"), F.col("parent")).alias("parent"), F.lit(0).cast("bigint").alias("n_docs"))
    text = _finds(docs, ROLES, 1).where("length(g1) between 2 and 10").groupBy(F.col("g1").alias("name")).agg(F.count_distinct("doc_id").alias("n_docs")).join(configured.select("name"), "name", "left_anti")
    return conf.unionByName(text.select("name", F.lit("text").alias("origin"), F.lit(None).cast("string").alias("parent"), "n_docs"))


def triggers_of_rules(atoms: DataFrame) -> DataFrame:
    """(rule_id, event_type, condition_expression, action_detail): rules with a comparison of a time or date become time_based triggers.  atoms: rule_id, part, predicate, variables."""
    text = F.concat("predicate", F.lit("("), F.array_join("variables", ", "), F.lit(")"))
    timed = (F.col("part") == "body") & F.col("predicate").isin("swrlb:greaterThan", "swrlb:lessThan") & F.exists("variables", lambda v: F.lower(v).rlike("time|date"))
    join = lambda part: F.array_join(F.array_sort(F.collect_list(F.when(F.col("part") == part, text))), " AND ")
    g = atoms.groupBy("rule_id").agg(F.bool_or(timed).alias("timed"), join("body").alias("condition_expression"), join("head").alias("action_detail"))
    return g.where("timed").select("rule_id", F.lit("time_based").alias("event_type"), "condition_expression", "action_detail")


def complete_comments(columns: DataFrame, guesses: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(table_name, column_name, comment, confidence): a model's guess (table_name, column_name, comment) for columns without comment, checked against a dictionary (column_name, comment): Jaccard of their characters over 0.7 is 0.9, else 0.3, without entry 0.6; no guess leaves 0 and an empty comment; a given comment stays with 1."""
    chars = lambda c: F.array_distinct(F.split(F.col(c), ""))
    d = dictionary.select("column_name", F.col("comment").alias("known"))
    g = guesses.select("table_name", "column_name", F.col("comment").alias("guess"))
    j = columns.join(g, ["table_name", "column_name"], "left").join(d, "column_name", "left")
    sim = F.size(F.array_intersect(chars("guess"), chars("known"))) / F.size(F.array_union(chars("guess"), chars("known")))
    given = F.coalesce("comment", F.lit("")) != ""
    conf = F.when(given, 1.0).when(F.coalesce("guess", F.lit("")) == "", 0.0).when(F.col("known").isNull(), 0.6).when(sim > 0.7, 0.9).otherwise(0.3)
    return j.select("table_name", "column_name", F.when(given, F.col("comment")).otherwise(F.coalesce("guess", F.lit(""))).alias("comment"), conf.alias("confidence"))
