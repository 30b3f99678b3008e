"""Queries of the layout operators on the driver's tables, each over whole tables, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import geometry as G
from ..functions import text as X
from ..operators import blocks as B
from ..operators import columns as C
from ..operators import furniture as U
from ..operators import grid as D
from ..operators import lines as L
from ..operators import metrics as M
from ..operators import pages as P
from ..operators import routing as R
from ..sources import files
from ..staging import cut
from . import adapters as A

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


# ---- pieces of DuckDB SQL -------------------------------------------------------------------------------------------

WS = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_NUM = rf"(?s)^(?:([0-9]+(?:\.[0-9]+)*)|（[{X.CN}]+[）)]?|[{X.CN}]+[）)]?|\([0-9]+\)|（[0-9]+）){WS}*[.、．]?{WS}*(.*)$"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def _lstrip(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+', '')"


def _rstrip(c: str) -> str:
    return f"regexp_replace({c}, '{WS}+$', '')"


def _level(c: str) -> str:
    t = _strip(c)
    d = f"regexp_extract({t}, '{_NUM}', 1)"
    return f"(case when upper({t}) in ('ABSTRACT', 'INTRODUCTION', 'REFERENCES', 'REFERENCE') then 2 when {_strip(f"regexp_extract({t}, '{_NUM}', 2)")} <> '' then least(6, greatest(2, length({d}) - length(replace({d}, '.', '')) + 2)) end)"


def _prefixed(c: str) -> str:
    v = _level(c)
    return f"(case when {_lstrip(c)} like '#%' or length({c}) > {S.TITLE_MAX} or {v} is null then {c} else repeat('#', {v}) || ' ' || {c} end)"


def _marker(c: str) -> str:
    t = _strip(c)
    return f"({t} <> '' and {t} not like '#%' and length({t}) <= 6 and (regexp_matches({t}, '^[-•·*]') or (length({t}) <= 3 and regexp_matches({t}, '^[A-Za-z][)）.、，,]')) or (length({t}) >= 3 and regexp_matches({t}, '^（[\\p{{N}}{X.CN}〇零]+）$'))))"


def _page_number(c: str) -> str:
    return f"regexp_matches({_strip(c)}, '^[0-9]{{1,4}}$')"


_BAD = r"length(regexp_replace({}, '[^\p{{Cc}}\x{{FFFD}}\x{{E000}}-\x{{F8FF}}]', '', 'g'))"


def _prose(c: str) -> str:
    return f"(length({c}) >= {S.PROSE_LENGTH} or regexp_matches({c}, '[。，；：]$'))"


# ---- lines ----------------------------------------------------------------------------------------------------------


@query(f"with {A.LINES}, n as (select doc_id, line_no, {A.NUMBERED} as line from l), v as (select doc_id, line_no, cast({_level('line')} as integer) as level from n) select * from v where level is not null")
def title_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.document_lines(spark, sf_dir, A.NUMBERED)
    return d.select("doc_id", "line_no", X.title_level(F.col("line")).alias("level")).where("level is not null")


@query(f"with {A.LINES}, n as (select doc_id, line_no, {A.NUMBERED} as line from l) select doc_id, line_no, {_prefixed('line')} as line from n")
def title_prefixed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.document_lines(spark, sf_dir, A.NUMBERED)
    return d.select("doc_id", "line_no", X.title_prefixed(F.col("line")).alias("line"))


@query(f"with {A.LINES}, n as (select {_prefixed(A.NUMBERED)} as line from l), v as (select cast(length(regexp_extract(line, '^(#{{1,6}})\\s', 1)) as integer) as level from n) select level, count(*) as n from v where level > 0 group by level")
def heading_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.document_lines(spark, sf_dir, A.NUMBERED).select(X.title_prefixed(F.col("line")).alias("line"))
    return M.heading_histogram(d, [])


@query(f"""with {A.LINES}, h as (select doc_id, 0 as hint_ord, regexp_extract(text, '^[^\\s.,]+', 0) as title, 2 as level from documents union all select doc_id, 1, 'the', 3 from documents),
    j as (select l.doc_id, l.line_no, l.line, arg_min(h.level, h.hint_ord) as hint from l left join h on l.doc_id = h.doc_id and (contains({_strip('l.line')}, h.title) or contains(h.title, {_strip('l.line')})) group by l.doc_id, l.line_no, l.line)
    select doc_id, line_no, case when {_lstrip('line')} like '#%' or hint is null then line else repeat('#', hint) || ' ' || line end as line from j""")
def title_hinted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = A.table(spark, sf_dir, "documents")
    h = docs.select("doc_id", F.explode(F.array(F.struct(F.lit(0).alias("hint_ord"), F.regexp_extract("text", r"^[^\s.,]+", 0).alias("title"), F.lit(2).alias("level")), F.struct(F.lit(1).alias("hint_ord"), F.lit("the").alias("title"), F.lit(3).alias("level")))).alias("h")).select("doc_id", "h.*")
    d = L.with_hints(L.explode_lines(docs), h, ["doc_id"], "line_no")
    return d.select("doc_id", "line_no", X.title_prefixed(F.col("line"), F.col("hint"), numbering=False).alias("line"))


@query(f"with {A.LINES}, w as (select doc_id, line_no, {A.FULLWIDTH} as wide from l) select doc_id, line_no, translate(wide, '{X.FULL}', '{X.HALF}') as half, translate(wide, '{X.WIDE.replace(chr(39), chr(39) * 2)}', '{X.NARROW.replace(chr(39), chr(39) * 2)}') as narrow from w")
def fullwidth_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.document_lines(spark, sf_dir, A.FULLWIDTH)
    return d.select("doc_id", "line_no", X.half_width(F.col("line")).alias("half"), X.half_width_all(F.col("line")).alias("narrow"))


@query(f"""with {A.LINES}, n as (select doc_id, line_no, {A.HYPHENED} as line from l),
    k as (select *, coalesce({_rstrip('lag(line) over w')} like '%-' and regexp_matches({_lstrip('line')}, '^[a-z]'), false) as taken from n window w as (partition by doc_id order by line_no)),
    g as (select *, coalesce(lead(taken) over w, false) as gives, sum(case when taken then 0 else 1 end) over (partition by doc_id order by line_no rows unbounded preceding) as run from k window w as (partition by doc_id order by line_no)),
    o as (select doc_id, run, line_no, case when taken then {_lstrip('line')} else line end as t, gives from g)
    select doc_id, min(line_no) as line_no, string_agg(case when gives then regexp_replace(t, '-{WS}*$', '') else t end, '' order by line_no) as line from o group by doc_id, run""")
def hyphen_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.merge_hyphens(A.document_lines(spark, sf_dir, A.HYPHENED), ["doc_id"], "line_no")


_Y = "cast(line_no * 10 + (line_no // 4) * 30 as double)"


@query(f"""with {A.LINES}, n as (select doc_id, line_no, {A.NUMBERED} as line, {_Y} as y from l),
    k as (select *, abs(y - lag(y) over w) as gap, ({_level('line')} is not null or {_lstrip('line')} like '#%') as head from n window w as (partition by doc_id order by line_no)),
    m as (select doc_id, list_sort(list(gap) filter (where gap is not null)) as v from k group by doc_id),
    c as (select k.*, (gap is null or head or lag(head) over (partition by k.doc_id order by line_no) or gap > greatest(coalesce(v[len(v) // 2 + 1], 20), 8) * 1.5) as cut from k join m on k.doc_id = m.doc_id),
    g as (select *, sum(case when cut then 1 else 0 end) over (partition by doc_id order by line_no rows unbounded preceding) as run from c)
    select doc_id, min(line_no) as line_no, string_agg(line, '' order by line_no) as line from g group by doc_id, run""")
def paragraph_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.document_lines(spark, sf_dir, A.NUMBERED).withColumn("y", F.expr("cast(line_no * 10 + (line_no div 4) * 30 as double)"))
    return L.paragraphs(d, ["doc_id"], "line_no", "y")


@query(f"with {A.LINES}, n as (select doc_id, line_no, {A.MARKED} as line from l) select * from n where {_marker('line')}")
def isolated_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.document_lines(spark, sf_dir, A.MARKED).where(X.is_isolated_marker(F.col("line")))


@query(f"with {A.LINES}, n as (select doc_id, line_no, {A.MARKED} as line from l) select * from n where length({_strip('line')}) = 1 and {_strip('line')} <> '#' and not {_marker('line')}")
def noise_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.document_lines(spark, sf_dir, A.MARKED).where(X.is_noise_fragment(F.col("line")))


@query(f"with {A.LINES}, n as (select doc_id, line_no, {A.MARKED} as line from l) select * from n where {_page_number('line')}")
def page_number_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.document_lines(spark, sf_dir, A.MARKED).where(X.is_page_number(F.col("line")))


@query(f"""with {A.LINES}, n as (select doc_id, line_no, {A.MARKED} as line from l),
    k as (select *, case when {_lstrip('line')} like '#%' then 'h' when {_marker('line')} then 'm' when {_page_number('line')} then 'n' else 't' end as kind from n),
    a as (select k.*, (select min(j.line_no) from k j where j.doc_id = k.doc_id and j.line_no > k.line_no and j.kind <> 'n') as nx, (select max(j.line_no) from k j where j.doc_id = k.doc_id and j.line_no < k.line_no and j.kind <> 'n') as bk from k),
    s as (select a.*, x.kind as nk, x.line as nl, y.kind as yk from a left join k x on x.doc_id = a.doc_id and x.line_no = a.nx left join k y on y.doc_id = a.doc_id and y.line_no = a.bk),
    o as (select doc_id, line_no, case when kind = 'n' and yk = 'm' then bk else line_no end as place, case when kind = 'm' then 1 else 0 end as late, case when kind = 'm' and nk = 't' then line || ' ' || {_lstrip('nl')} else line end as line from s where not (kind = 't' and coalesce(yk, '') = 'm'))
    select doc_id, cast(row_number() over (partition by doc_id order by place, late, line_no) as integer) as pos, line from o""")
def marker_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.pair_markers(A.document_lines(spark, sf_dir, A.MARKED), ["doc_id"], "line_no")


# ---- health and routing ---------------------------------------------------------------------------------------------

_DIRTY = "case when doc_id % 3 = 0 then replace(text, 'e', chr(65533)) else text end"


@query(f"with d as (select doc_id, {_DIRTY} as text from documents), g as (select doc_id, cast(sum(length(text)) as bigint) as n_chars, cast(sum({_BAD.format('text')}) as bigint) as n_garbled from d group by doc_id) select *, n_chars > 50 and n_garbled * 100 >= n_chars * 20 as garbled from g")
def garble_by_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.table(spark, sf_dir, "documents").select("doc_id", F.expr(_DIRTY.replace("chr(65533)", "'�'")).alias("text"))
    return R.text_health(d, ["doc_id"])


@query(f"""with d as (select doc_id, source, doc_id % 3 as page, {_DIRTY} as text from documents), i as (select source, doc_id, text, row_number() over (partition by source order by doc_id) as rn from d),
    g as (select source, cast(sum(length(text)) as bigint) as n_chars, cast(sum({_BAD.format('text')}) as bigint) as n_garbled from i where rn <= 4000 group by source) select *, n_chars > 50 and n_garbled * 100 >= n_chars * 20 as garbled from g""")
def garble_shallow(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.table(spark, sf_dir, "documents").select("doc_id", "source", F.expr(_DIRTY.replace("chr(65533)", "'�'")).alias("text"))
    return R.shallow_health(d, "source", ["doc_id"])


@query(f"""with d as (select doc_id, source, {_DIRTY} as text from documents), g as (select source, length(text) > 50 and {_BAD.format('text')} * 100 >= length(text) * 20 as garbled from d)
    select source, count(*) as n_pages, count(*) filter (where garbled) as n_bad, count(*) filter (where garbled) >= 3 and count(*) filter (where garbled) * 100 >= count(*) * 20 as deep_garbled from g group by source""")
def garble_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.table(spark, sf_dir, "documents").select("source", F.expr(_DIRTY.replace("chr(65533)", "'�'")).alias("text"))
    return R.deep_health(d.select("source", X.is_garbled(F.length("text"), X.garbled(F.col("text"))).alias("garbled")), "source")


@query("""with s as (select d.doc_id, n_chars = 0 as a, quality = 0 as b, toxic = 1 as c, n_chars < 200 as e, d.doc_id % 2 = 0 as f, case when lang = 'en' then 'page' else 'doc' end as scope from documents d left join labels l on d.doc_id = l.doc_id)
    select doc_id, case when not coalesce(a or b or c or (e and f), false) then 'text_layer' when scope = 'page' then 'ocr_page' else 'ocr_doc' end as route from s""")
def signal_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.table(spark, sf_dir, "documents").join(A.table(spark, sf_dir, "labels"), "doc_id", "left")
    c = F.col
    route = R.decide(c("n_chars") == 0, c("quality") == 0, c("toxic") == 1, c("n_chars") < 200, c("doc_id") % 2 == 0, F.when(c("lang") == "en", "page").otherwise("doc"))
    return d.select("doc_id", route.alias("route"))


@query("""select doc_id, case when doc_id % 11 = 0 then 'done_error' when lang <> 'en' then 'per_doc' when n_chars > 500 and not doc_id % 5 = 0 then 'done_text' else 'ocr' end as route from documents""")
def document_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.table(spark, sf_dir, "documents")
    kind = F.when(F.col("lang") == "en", "pdf").otherwise("ofd")
    return d.select("doc_id", R.route_document(kind, F.col("n_chars") > 500, F.col("doc_id") % 5 == 0, F.when(F.col("doc_id") % 11 == 0, "io")).alias("route"))


@query("""select page_id, case when page_id % 10 = 0 or (not page_id % 7 = 0 and length(html) % 9 < 5 and page_id % 4 > 0) then 'ocr_pending' when page_id % 7 = 0 then 'ocr_full' else 'text' end as route from pages""")
def ofd_page_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.table(spark, sf_dir, "pages")
    return d.select("page_id", R.ofd_page_route(F.length("html") % 9, F.col("page_id") % 4, F.col("page_id") % 7 == 0, F.col("page_id") % 10 == 0).alias("route"))


@query("with c as (select source, d.doc_id % 5 as page_no, quality from documents d left join labels l on d.doc_id = l.doc_id) select source, page_no, avg(quality) as mean_confidence, coalesce(avg(quality) < 0.6, true) as needs_upgrade from c group by source, page_no")
def page_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.table(spark, sf_dir, "documents").join(A.table(spark, sf_dir, "labels"), "doc_id", "left").withColumn("page_no", F.col("doc_id") % 5)
    return R.page_quality(d, ["source", "page_no"], "quality")


@query("""with q as (select d.doc_id, coalesce(avg(quality) < 0.6, true) as bad from documents d left join labels l on d.doc_id = l.doc_id group by d.doc_id), n as (select d.doc_id, 'retry ' || n_chars as text from documents d join q on d.doc_id = q.doc_id where bad and d.doc_id % 4 > 0)
    select d.doc_id, case when n.doc_id is not null then n.text else d.source end as text, n.doc_id is not null as retried from documents d left join n on d.doc_id = n.doc_id""")
def retry_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = A.table(spark, sf_dir, "documents")
    bad = R.page_quality(docs.join(A.table(spark, sf_dir, "labels"), "doc_id", "left"), ["doc_id"], "quality").where("needs_upgrade")
    again = docs.join(bad, "doc_id", "left_semi").where("doc_id % 4 > 0").select("doc_id", F.concat(F.lit("retry "), F.col("n_chars")).alias("text"))
    return R.merge_retry(docs.select("doc_id", F.col("source").alias("text")), again, ["doc_id"])


@query("select doc_id, case doc_id % 3 when 0 then 'tiny' when 1 then 'small' else 'medium' end as tier, case doc_id % 3 when 0 then 'small' when 1 then 'medium' end as next_tier from documents")
def tier_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.table(spark, sf_dir, "documents").select("doc_id", F.expr("case doc_id % 3 when 0 then 'tiny' when 1 then 'small' else 'medium' end").alias("tier"))
    return d.withColumn("next_tier", R.next_tier(F.col("tier")))


@query("select l_orderkey as doc_id, count(*) filter (where l_returnflag = 'A') = 1 and count(*) filter (where l_returnflag = 'R') = 0 as direct from lineitem group by l_orderkey")
def single_image_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.expr("case l_returnflag when 'A' then 'image' when 'R' then 'path' else 'text' end").alias("obj_type"))
    return R.single_image_pages(d, ["doc_id"])


@query("""select o_orderkey as path, cast(o_orderkey % 1000 as integer) as ord, case when l_label is not null and l_label = 1 then 'ok' end as markdown, case when l_label is null then '[convert] runtime: no result' when l_label = 0 then '[ocr:page3] malformed document: x' end as error
    from orders left join (select doc_id, quality as l_label from labels) on doc_id = o_orderkey""")
def outcome_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), (F.col("o_orderkey") % 1000).cast("int").alias("ord"))
    bad = F.struct(F.lit("malformed").alias("kind"), F.lit("ocr").alias("stage"), F.lit(3).alias("page"), F.lit("x").alias("detail"))
    res = A.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("path"), F.when(F.col("quality") == 1, "ok").alias("markdown"), F.when(F.col("quality") == 0, bad).alias("error"))
    d = R.fill_slots(docs, res)
    e = F.when(F.col("error").isNotNull(), R.error_text(F.col("error.stage"), F.col("error.page"), F.col("error.kind"), F.col("error.detail")))
    return d.select("path", "ord", "markdown", e.alias("error"))


@query("select source, count(*) filter (where quality is not null) as ok, count(*) filter (where quality is null) as failed from documents d left join labels l on d.doc_id = l.doc_id group by source")
def outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.table(spark, sf_dir, "documents").join(A.table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.groupBy("source").agg(F.count_if(F.col("quality").isNotNull()).alias("ok"), F.count_if(F.col("quality").isNull()).alias("failed"))


_KINDS = list(S.ERRORS)


@query("select doc_id, case doc_id % 8 " + " ".join("when {} then '{}'".format(i, S.ERRORS[k][1].replace("'", "''")) for i, k in enumerate(_KINDS)) + f" else '{S.NO_HINT}' end as hint from documents")
def error_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.expr("case doc_id % 8 " + " ".join(f"when {i} then '{k}'" for i, k in enumerate(_KINDS)) + " else 'odd' end")
    return A.table(spark, sf_dir, "documents").select("doc_id", R.error_hint(kind).alias("hint"))


# ---- furniture ------------------------------------------------------------------------------------------------------

_FURN = f"""{A.LINES}, i as (select d.source, d.doc_id, l.line_no, l.line, {_strip('l.line')} as t from l join documents d on d.doc_id = l.doc_id), n as (select source, max(doc_id) as top, count(distinct doc_id) as pages from i group by source),
    k as (select i.source, t, count(distinct doc_id) as c, any_value(pages) as pages from i join n on n.source = i.source where t <> '' group by i.source, t), f as (select source, t from k where c >= greatest(3, ceil(cast(pages as float) * cast(0.1 as float))) and pages >= greatest(3, ceil(cast(pages as float) * cast(0.1 as float))))"""


def _furniture_items(spark, sf_dir):
    docs = A.table(spark, sf_dir, "documents")
    page = F.dense_rank().over(W.partitionBy("source").orderBy("doc_id"))
    return L.explode_lines(docs.select(F.struct("source", page.alias("page"), "doc_id").alias("key"), "text"), "key").select("key.*", "line_no", "line")


@query(f"with {_FURN} select source, t as text from f")
def furniture_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.furniture_keys(_furniture_items(spark, sf_dir), "source", "page", "line", ratio=0.1).withColumnRenamed("__text", "text")


@query(f"with {_FURN} select source, doc_id, line_no, line from i where not exists (select 1 from f where f.source = i.source and f.t = i.t)")
def furniture_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.strip_furniture(_furniture_items(spark, sf_dir), "source", "page", "line", ratio=0.1).select("source", "doc_id", "line_no", "line")


# ---- columns and reading order --------------------------------------------------------------------------------------

_FULL = f"{A.REGIONS}, f as (select *, page_w * 0.92 < x_max - x_min and x_min < page_w * 0.08 as fw from (select *, greatest(max(x_max) over (partition by doc_id), 0) as page_w, (x_min + x_max) / 2 as cx from r))"
_SPLIT = f"""{_FULL}, body as (select doc_id, cx, row_number() over w as rn, lag(cx) over w as p, count(*) over (partition by doc_id) as nb from f where not fw window w as (partition by doc_id order by cx, region_idx)),
    best as (select * from body where p is not null qualify row_number() over (partition by doc_id order by cx - p desc, rn) = 1), tot as (select doc_id, count(*) as n, max(page_w) as page_w from f group by doc_id),
    s0 as (select best.doc_id, (p + cx) / 2 as split from best join tot on tot.doc_id = best.doc_id where n >= 4 and nb >= 4 and page_w > 0 and cx - p > 0 and cx - p >= page_w * 0.03 and rn - 1 >= 2 and nb - (rn - 1) >= 2),
    s as (select * from s0 where not exists (select 1 from f where f.doc_id = s0.doc_id and not fw and x_min < split and split < x_max))"""
_KEY = ["doc_id"]


@query(f"with {_FULL} select doc_id, region_idx, page_w, fw as full_width from f")
def full_width_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.with_page_width(A.regions(spark, sf_dir), _KEY).select("doc_id", "region_idx", "page_w", F.col("full").alias("full_width"))


@query(f"with {_SPLIT} select doc_id, split from s")
def column_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.with_column_split(A.regions(spark, sf_dir), _KEY).where("split is not null").select("doc_id", "split").distinct()


@query(f"""with {_SPLIT}, e as (select doc_id, min(y_min) filter (where not fw) as top, max(y_min) filter (where not fw) as bottom from f group by doc_id),
    o as (select f.doc_id, region_idx, y_min, cast(case when split is null or page_w <= 0 then 0 when not fw then case when cx < split then 1 else 2 end when y_min < top then 0 when y_min > bottom then 4 else 3 end as integer) as section from f join e on e.doc_id = f.doc_id left join s on s.doc_id = f.doc_id)
    select doc_id, region_idx, section, cast(row_number() over (partition by doc_id order by section, y_min, region_idx) as integer) as pos from o""")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.reading_order(A.regions(spark, sf_dir), _KEY).select("doc_id", "region_idx", "section", "pos")


@query(f"""with {_SPLIT}, o as (select f.doc_id, region_idx, y_min, cast(case when split is null or page_w <= 0 then 0 when fw then 0 when cx < split then 1 else 2 end as integer) as section from f left join s on s.doc_id = f.doc_id)
    select doc_id, region_idx, section, cast(row_number() over (partition by doc_id order by section, y_min, region_idx) as integer) as pos from o""")
def order_within_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.reading_order(A.regions(spark, sf_dir), _KEY, in_block=True).select("doc_id", "region_idx", "section", "pos")


_TALL = "r2 as (select doc_id, region_idx, x_min, x_min + 4 + region_idx % 5 as x_max, y_min, y_min + 60 as y_max, text from r)"


def _tall(spark, sf_dir):
    return A.regions(spark, sf_dir).selectExpr("doc_id", "region_idx", "x_min", "x_min + 4 + region_idx % 5 as x_max", "y_min", "y_min + 60 as y_max", "text")


@query(f"""with {A.REGIONS}, {_TALL}, c as (select *, x_max - x_min as w, (x_min + x_max) / 2 as cx, greatest(max(x_max) over (partition by doc_id), 0) as pw from r2),
    k as (select * from c where y_max - y_min > greatest(w, 1) * 2.5 and greatest(w, 1) < pw * 0.4),
    a as (select doc_id, list({{'cx': cx, 'i': region_idx, 'w': w, 'y': y_min, 't': text, 'a': cast(null as double), 'g': 0}} order by cx, region_idx) as v from k group by doc_id),
    q as (select doc_id, list_reduce(list_transform(v, lambda x : [x]), lambda p, x : list_append(p, struct_update(x[1], a := case when p[-1].a is not null and abs(p[-1].a - x[1].cx) <= greatest(x[1].w * 1.5, 6) then p[-1].a else x[1].cx end, g := case when p[-1].a is not null and abs(p[-1].a - x[1].cx) <= greatest(x[1].w * 1.5, 6) then p[-1].g else p[-1].g + 1 end)), [{{'cx': 0.0, 'i': 0, 'w': 0.0, 'y': 0.0, 't': '', 'a': cast(null as double), 'g': 0}}]) as o from a),
    u as (select doc_id, unnest(o[2:]) as z from q) select doc_id, cast(dense_rank() over (partition by doc_id order by z.a desc, z.g) as integer) as col_no, cast(row_number() over (partition by doc_id, z.g order by z.y, z.cx, z.i) as integer) as row_no, z.i as region_idx, z.t as text from u""")
def vertical_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.vertical_columns(_tall(spark, sf_dir), _KEY)


_SEG = f"{A.ITEMS}, g as (select *, lag(x + width) over (partition by doc_id, line_no order by x, item_idx) as e, max(x + width) over (partition by doc_id) as pw from t)"


@query(f"""with {_SEG}, m as (select doc_id, (x + e) / 2 as mid, pw from g where x - e > pw * 0.03 qualify row_number() over (partition by doc_id, line_no order by x - e desc, item_idx) = 1),
    p as (select doc_id, list(mid order by mid) as v, max(pw) as pw from m group by doc_id),
    q as (select doc_id, len(v) as n, list_reduce(list_transform(v, lambda x : [{{'a': x, 'n': 1, 's': x}}]), lambda c, x : case when len(c) > 0 and abs(c[-1].a - x[1].a) <= pw * 0.02 then list_append(c[:-2], {{'a': c[-1].a, 'n': c[-1].n + 1, 's': c[-1].s + x[1].a}}) else list_append(c, x[1]) end) as c from p),
    u as (select doc_id, n, unnest(c) as z, unnest(range(len(c))) as i from q), b as (select * from u qualify row_number() over (partition by doc_id order by z.n desc, i desc) = 1)
    select doc_id, case when n >= 3 and z.n >= 3 then z.s / z.n end as gutter from b""")
def line_gutters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.gutter(A.items(spark, sf_dir), _KEY)


@query(f"""with {_SEG}, u as (select distinct doc_id, case when doc_id % 2 = 0 then 300.0 end as gutter from t),
    c as (select g.*, gutter, case when gutter is not null and x - e > pw * 0.01 then abs((x + e) / 2 - gutter) end as d from g join u on u.doc_id = g.doc_id),
    b as (select doc_id, line_no, x as bx, item_idx as bi from c where d is not null qualify row_number() over (partition by doc_id, line_no order by d, x, item_idx) = 1)
    select c.doc_id, c.line_no, c.item_idx, cast(case when bx is not null and (x > bx or (x = bx and item_idx >= bi)) then 1 else 0 end as integer) as part from c left join b on b.doc_id = c.doc_id and b.line_no = c.line_no""")
def line_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = A.items(spark, sf_dir)
    g = t.select("doc_id").distinct().select("doc_id", F.expr("case when doc_id % 2 = 0 then cast(300 as double) end").alias("gutter"))
    return C.split_lines(t, g, _KEY).select("doc_id", "line_no", "item_idx", "part")


@query(f"with {_SEG}, s as (select doc_id, line_no, count(*) filter (where x - e > pw * 0.01) + 1 as s from g group by doc_id, line_no) select doc_id, count(*) filter (where s >= 3) >= 3 as tabular from s group by doc_id")
def tabular_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.tabular_pages(A.items(spark, sf_dir), _KEY)


# ---- blocks ---------------------------------------------------------------------------------------------------------

_IN = "{b}.doc_id = r.doc_id and (r.x_min + r.x_max) / 2 between {b}.x_min and {b}.x_max and {y} between {b}.y_min and {b}.y_max"


@query(f"with {A.REGIONS}, {A.BOXES} select r.doc_id, r.region_idx, min(block_rank) as block_rank from r left join b on {_IN.format(b='b', y='r.y_min')} group by r.doc_id, r.region_idx")
def block_claim_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.claim(A.regions(spark, sf_dir), A.boxes(spark, sf_dir), _KEY).select("doc_id", "region_idx", "block_rank")


@query(f"""with {A.REGIONS}, {A.BOXES}, w as (select r.doc_id, max(r.x_max) as tw, max(r.y_max) as th from r group by r.doc_id), v as (select doc_id, max(x_max) as lw, max(y_max) as lh from b group by doc_id),
    s as (select r.*, tw, th, lw, lh from r join w on w.doc_id = r.doc_id join v on v.doc_id = r.doc_id)
    select r.doc_id, r.region_idx, min(block_rank) as block_rank from r left join s on s.doc_id = r.doc_id and s.region_idx = r.region_idx left join b on b.doc_id = s.doc_id and (s.x_min + s.x_max) / 2 / tw >= b.x_min / lw and (s.x_min + s.x_max) / 2 / tw <= b.x_max / lw and s.y_min / th >= b.y_min / lh and s.y_min / th <= b.y_max / lh group by r.doc_id, r.region_idx""")
def block_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, b = A.regions(spark, sf_dir), A.boxes(spark, sf_dir)
    return B.claim(r, b, _KEY, B.page_scale(r, b, _KEY)).select("doc_id", "region_idx", "block_rank")


@query(f"with {A.REGIONS}, {A.NOISE} select r.doc_id, r.region_idx from r where not exists (select 1 from z where {_IN.format(b='z', y='(r.y_min + r.y_max) / 2')})")
def noise_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.outside(A.regions(spark, sf_dir), A.noise(spark, sf_dir), _KEY).select("doc_id", "region_idx")


@query(f"with {A.REGIONS}, {A.BOXES}, {A.NOISE}, c as (select r.doc_id, r.region_idx, min(block_rank) as k from r left join b on {_IN.format(b='b', y='r.y_min')} group by r.doc_id, r.region_idx) select r.doc_id, r.region_idx from r join c on c.doc_id = r.doc_id and c.region_idx = r.region_idx where k is null and not exists (select 1 from z where {_IN.format(b='z', y='(r.y_min + r.y_max) / 2')})")
def leftover_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = B.claim(A.regions(spark, sf_dir), A.boxes(spark, sf_dir), _KEY).where("block_rank is null")
    return B.outside(c, A.noise(spark, sf_dir), _KEY).select("doc_id", "region_idx")


@query("""with e as (select l_orderkey as doc_id, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) as integer) as el_idx, case when l_suppkey % 3 > 0 then l_suppkey % 5 end as order_index, l_linenumber as y_min, l_returnflag as t from lineitem)
    select doc_id, el_idx, cast(row_number() over (partition by doc_id order by order_index nulls last, case when order_index is null then y_min end, el_idx) as integer) as block_rank from e where t <> 'R'""")
def block_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as doc_id", A.REGION_COLUMNS[1].replace("region_idx", "el_idx"), "case when l_suppkey % 3 > 0 then l_suppkey % 5 end as order_index", "l_linenumber as y_min", "case when l_returnflag = 'R' then 'footer' else 'text' end as element_type")
    return B.block_order(d, _KEY).select("doc_id", "el_idx", "block_rank")


# ---- grids ----------------------------------------------------------------------------------------------------------

_ROWS = f"""{A.REGIONS}, ra as (select doc_id, list({{'y': y_min, 'i': region_idx, 'a': cast(null as double), 'g': 0}} order by y_min, region_idx) as v from r group by doc_id),
    rb as (select doc_id, list_reduce(list_transform(v, lambda x : [x]), lambda p, x : list_append(p, struct_update(x[1], a := case when p[-1].a is not null and abs(p[-1].a - x[1].y) <= 21 then p[-1].a else x[1].y end, g := case when p[-1].a is not null and abs(p[-1].a - x[1].y) <= 21 then p[-1].g else p[-1].g + 1 end)), [{{'y': 0.0, 'i': 0, 'a': cast(null as double), 'g': 0}}]) as o from ra),
    rc as (select doc_id, unnest(o[2:]) as z from rb), rows_ as (select r.*, cast(z.g as integer) as row_no from rc join r on r.doc_id = rc.doc_id and r.region_idx = z.i)"""
_CELLS = f"""{_ROWS}, ca as (select *, coalesce(x_min - lag(x_max) over w > 6, true) as cut from rows_ window w as (partition by doc_id, row_no order by x_min, region_idx)),
    cb as (select *, cast(sum(case when cut then 1 else 0 end) over (partition by doc_id, row_no order by x_min, region_idx rows unbounded preceding) as integer) as cell_no from ca),
    cells as (select doc_id, row_no, cell_no, arg_min(x_min, {{'x': x_min, 'i': region_idx}}) as x, arg_min(y_min, {{'x': x_min, 'i': region_idx}}) as y, max(y_max - y_min) as h, string_agg(text, ' ' order by x_min, region_idx) as text from cb group by doc_id, row_no, cell_no)"""
_COLS = f"{_CELLS}, na as (select doc_id, row_no, count(*) as k from cells group by doc_id, row_no), nb as (select doc_id, k from na where k >= 2 group by doc_id, k having count(*) >= 2), cols as (select doc_id, cast(max(k) as integer) as cols from nb group by doc_id)"
_CENT = f"{_COLS}, xa as (select c.doc_id, c.cell_no - 1 as col, list_sort(list(x)) as v from cells c join na on na.doc_id = c.doc_id and na.row_no = c.row_no join cols on cols.doc_id = c.doc_id where k = cols.cols group by c.doc_id, c.cell_no - 1), cent as (select doc_id, cast(col as integer) as col, v[len(v) // 2 + 1] as center from xa)"
_PLACE = f"""{_CENT}, pa as (select c.*, p.col, row_number() over (partition by c.doc_id, c.row_no, c.cell_no order by abs(x - center), p.col) as n from cells c join na on na.doc_id = c.doc_id and na.row_no = c.row_no and k >= 2 join cent p on p.doc_id = c.doc_id),
    placed as (select doc_id, row_no, col, x, y, h, text from pa where n = 1 qualify row_number() over (partition by doc_id, row_no, col order by text = '', x, cell_no) = 1)"""


def _row_groups(spark, sf_dir):
    return D.row_groups(A.regions(spark, sf_dir), _KEY, F.lit(21.0))


def _cells(spark, sf_dir):
    return cut(D.cells(_row_groups(spark, sf_dir), _KEY, F.lit(6.0)))


@query(f"with {_ROWS} select doc_id, region_idx, row_no from rows_")
def row_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _row_groups(spark, sf_dir).select("doc_id", "region_idx", "row_no")


@query(f"with {_CELLS} select doc_id, row_no, cell_no, x, y, h, text from cells")
def cell_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir)


@query(f"with {_COLS} select doc_id, cols from cols")
def grid_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.column_count(_cells(spark, sf_dir), _KEY)


@query(f"with {_CENT} select doc_id, col, center from cent")
def column_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _cells(spark, sf_dir)
    return D.column_centers(c, D.column_count(c, _KEY), _KEY)


def _placed(spark, sf_dir):
    return D.place(A.regions(spark, sf_dir), _KEY, F.lit(21.0), F.lit(6.0))


@query(f"with {_PLACE} select doc_id, row_no, col, x, y, h, text from placed")
def cell_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir)


@query(f"""with {_PLACE}, al as (select *, min(row_no) over (partition by doc_id) as f from placed), ac as (select doc_id, col, count(*) filter (where row_no > f and text <> '') as n, max(x) filter (where row_no > f and text <> '') - min(x) filter (where row_no > f and text <> '') as d from al group by doc_id, col)
    select doc_id, bool_and(n < 2 or d <= 12.8) as aligned from ac group by doc_id""")
def grid_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.alignment(_placed(spark, sf_dir), _KEY, F.lit(640.0))


@query(f"""with {_PLACE}, al as (select *, min(row_no) over (partition by doc_id) as f from placed), ac as (select doc_id, col, list_sort(coalesce(list(x) filter (where row_no > f and text <> ''), [])) as v from al group by doc_id, col)
    select doc_id, bool_and(len(v) < 2 or len(list_filter(v, lambda a : abs(a - v[len(v) // 2 + 1]) > 12.8)) * 100 <= len(v) * 30) as aligned from ac group by doc_id""")
def grid_alignment_tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.alignment(_placed(spark, sf_dir), _KEY, F.lit(640.0), tolerant=True)


@query()
def grid_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = D.reconstruct(A.regions(spark, sf_dir), _KEY)
    return g.select("doc_id", "cols", "has_header", F.size("rows").alias("n_rows"), D.to_html(g).alias("html"))


_AS_CELLS = f"{A.LINES}, c as (select doc_id, cast(line_no // 2 as integer) as row, cast(line_no % 2 as integer) as col, {_strip('line')} as t from l)"


@query(f"with {_AS_CELLS}, a as (select doc_id, max(row) + 1 as nr, max(col) + 1 as nc, count(*) filter (where t <> '') as n, count(*) filter (where t <> '' and {_prose('t')}) as p from c group by doc_id) select doc_id, nr < 2 or nc < 2 or (nc = 2 and n > 0 and p * 10 > n * 6) as false_positive from a")
def false_positive_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = A.table(spark, sf_dir, "documents")
    c = L.explode_lines(docs).select("doc_id", F.expr("cast(line_no div 2 as int)").alias("row"), (F.col("line_no") % 2).alias("col"), F.col("line").alias("text"))
    return D.false_positive(docs.select("doc_id"), c, _KEY)


# ---- pages and rendering --------------------------------------------------------------------------------------------

_ISLES = f"{A.PAGES}, i0 as (select *, cols is not null and not coalesce(lag(cols) over w = cols, false) as b from p window w as (partition by doc_id order by page_pos)), isles as (select doc_id, page_pos, cols, text, cast(sum(case when b then 1 else 0 end) over (partition by doc_id order by page_pos rows unbounded preceding) as integer) as island from i0 qualify cols is not null)"


@query(f"with {_ISLES} select doc_id, page_pos, cols, island from isles")
def cross_page_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.table_islands(A.pages(spark, sf_dir), "doc_id", "page_pos", "cols").select("doc_id", "page_pos", "cols", "island")


@query(f"""with {_ISLES}, h as (select *, 'h' || length(text) % 2 as head, row_number() over (partition by doc_id, island order by page_pos) as n from isles), f as (select doc_id, island, page_pos, cols, head, length(text) % 5 > 0 as has_header from h where n = 1)
    select f.doc_id, f.page_pos, f.cols, cast(sum(2 - case when n > 1 and f.has_header and 'h' || length(text) // 2 % 2 = f.head then 1 else 0 end) as integer) as n_rows, string_agg(case when n > 1 and f.has_header and 'h' || length(text) // 2 % 2 = f.head then '' else 'h' || length(text) // 2 % 2 || ';' end || h.page_pos || ';', '' order by h.page_pos) as body
    from h join f on f.doc_id = h.doc_id and f.island = h.island group by f.doc_id, f.page_pos, f.cols, f.island""")
def cross_page_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = lambda t: f"array_repeat(named_struct('text', {t}, 'x', 0f, 'y', 0f, 'h', 0f), cols)"
    p = A.pages(spark, sf_dir)
    g = p.where("cols is not null").selectExpr("doc_id", "page_pos", "cols", "length(text) % 5 > 0 as has_header", cell("'h' || length(text) % 2") + " as header", f"array({cell("'h' || (length(text) div 2) % 2")}, {cell('cast(page_pos as string)')}) as rows")
    m = P.merge_tables(g, p)
    body = F.array_join(F.transform("rows", lambda r: F.concat(F.element_at(r, 1)["text"], F.lit(";"))), "")
    return m.select("doc_id", "page_pos", "cols", F.size("rows").alias("n_rows"), body.alias("body"))


@query("select page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as escaped from pages")
def html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "pages").select("page_id", X.escape_html(F.col("html")).alias("escaped"))


_WRAP = "case page_id % 3 when 0 then '<html><table border=1>' || html || '</table>' || html when 1 then ' x <table>' || html || '</table' else html end"


@query(f"with w as (select page_id, {_WRAP} as t from pages), e as (select *, regexp_extract(t, '(?s)(<table.*</table)', 1) as x from w) select page_id, case when x <> '' then x || '>' else {_strip('t')} end as html from e")
def table_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "pages").select("page_id", X.table_html(F.expr(_WRAP)).alias("html"))


#: some lines empty, also several together and at the start; in SQL the segment grows line by line and is looked at each time
_GAPPED = f"case when line_no % 7 in (3, 4) or (line_no = 0 and doc_id % 5 = 0) then '' else {A.NUMBERED} end"
_MD = f"""{A.LINES}, n as (select doc_id, line_no, {_GAPPED} as raw from l), v as (select doc_id, list({_prefixed('raw')} order by line_no) as t from n group by doc_id),
    seg as (select doc_id, list_reduce(t, lambda s, x : s || case when x like '#%' and s <> '' and right(s, 2) <> chr(10) || chr(10) then chr(10) else '' end || x || case when x like '#%' then chr(10) || chr(10) else chr(10) end, '') as segment from v)"""


def _segments(spark, sf_dir):
    d = A.document_lines(spark, sf_dir, _GAPPED)
    d = d.select("doc_id", F.lit("pdf").alias("source"), F.lit("body").alias("kind"), F.col("line_no").alias("pos"), X.title_prefixed(F.col("line")).alias("text"))
    return P.render_pages(d, _KEY)


@query(f"with {_MD} select doc_id, segment from seg")
def render_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir)


@query(f"with {_MD}, d as (select doc_id // 3 as book, doc_id % 3 as page, {_strip('segment')} as t from seg) select book, coalesce(string_agg(t, chr(10) || chr(10) order by page) filter (where t <> ''), '') as markdown from d group by book")
def render_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _segments(spark, sf_dir).selectExpr("doc_id div 3 as book", "doc_id % 3 as page", "0 as pos", "segment")
    return P.render_documents(s, "book", "page", "pos")


# ---- metrics --------------------------------------------------------------------------------------------------------


@query("with v as (select event_type, list_sort(list(value)) as v from events group by event_type) select event_type, len(v) as n, v[len(v) // 2 + 1] as p50, v[cast(least(greatest(ceil(len(v) * 95 / 100) - 1, 0), len(v) - 1) as integer) + 1] as p95, list_max(v) as max from v")
def stage_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.percentiles(A.table(spark, sf_dir, "events").where("value is not null"), ["event_type"], "value")


_STAGES = ["click", "view"]


@query("with s as (select user_id, " + ", ".join(f"coalesce(sum(value) filter (where event_type = '{s}'), 0) as {s}" for s in _STAGES) + " from events group by user_id) select user_id, round(click, 6) as click, round(view, 6) as view, round(click + view, 6) as total from s")
def page_timing_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = M.page_timings(A.table(spark, sf_dir, "events"), "user_id", "event_type", "value", _STAGES)
    return d.select("user_id", *[F.round(c, 6).alias(c) for c in (*_STAGES, "total")])


_PAIRS = "q as (select doc_id, line_no, line as a, lead(line) over (partition by doc_id order by line_no) as b from l)"


def _pairs(spark, sf_dir):
    return L.line_pairs(A.table(spark, sf_dir, "documents"))


def _norm(c: str) -> str:
    n = f"translate({c}, '{X.WIDE.replace(chr(39), chr(39) * 2)}', '{X.NARROW.replace(chr(39), chr(39) * 2)}')"
    n = f"regexp_replace({n}, 'https?://\\S+', '', 'g')"
    n = f"regexp_replace({n}, '\\[([^\\[\\]]*)\\]\\([^()]*\\)', '\\1', 'g')"
    n = f"regexp_replace({n}, '[#>*`|_~]', '', 'g')"
    return f"lower(regexp_replace({n}, '[^{X.CJK}A-Za-z0-9。，、；：？！（）《》.,;:?!()]', '', 'g'))"


@query(f"with {A.LINES}, {_PAIRS}, s as (select doc_id, line_no, list_distinct(string_split({_norm('a')}, '')) as x, list_distinct(string_split({_norm('b')}, '')) as y from q where b is not null), t as (select doc_id, line_no, list_filter(x, lambda c : c <> '') as x, list_filter(y, lambda c : c <> '') as y from s) select doc_id, line_no, len(list_intersect(x, y)) / greatest(len(x), 1) as recall from t")
def charset_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("doc_id", "line_no", M.charset_recall(F.col("a"), F.col("b")).alias("recall"))


def _gram_recall(n):
    g = lambda c: f"list_distinct(list_transform(range(1, greatest(length({c}) - {n - 1}, 0) + 1), lambda i : substring({c}, i, {n})))"
    return f"len(list_intersect({g('a')}, {g('b')})) / greatest(len({g('a')}), 1)"


@query(f"with {A.LINES}, {_PAIRS} select doc_id, line_no, {_gram_recall(1)} as r1, {_gram_recall(2)} as r2, {_gram_recall(3)} as r3 from q where b is not null")
def ngram_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _pairs(spark, sf_dir).select("doc_id", "line_no", M.ngram_recalls(F.col("a"), F.col("b"), 3).alias("r"))
    return d.select("doc_id", "line_no", *[F.get("r", F.lit(n - 1)).alias(f"r{n}") for n in (1, 2, 3)])


@query(f"with {A.LINES}, {_PAIRS}, s as (select doc_id, line_no, list_distinct(regexp_extract_all(a, '[a-z]{{4,}}')) as x, list_distinct(regexp_extract_all(b, '[a-z]{{4,}}')) as y from q where b is not null), t as (select doc_id, line_no, len(list_intersect(x, y)) / greatest(len(x), 1) as recall, len(list_intersect(x, y)) / greatest(len(y), 1) as precision from s) select *, case when recall + precision > 0 then 2 * recall * precision / (recall + precision) else 0 end as f1 from t")
def term_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, p, f = M.term_scores(F.col("a"), F.col("b"), "[a-z]{4,}")
    return _pairs(spark, sf_dir).select("doc_id", "line_no", r.alias("recall"), p.alias("precision"), f.alias("f1"))


_ASCII = "regexp_replace({}, '[^ -~]', '?'{})"


@query(f"with {A.LINES}, {_PAIRS}, s as (select doc_id, line_no, {_ASCII.format('a', ", 'g'")} as a, {_ASCII.format('b', ", 'g'")} as b from q where b is not null) select doc_id, line_no, case when a = '' then case when b = '' then 0 else 1 end else levenshtein(a, b) / length(a) end as cer from s")
def cer_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _pairs(spark, sf_dir).select("doc_id", "line_no", F.expr(_ASCII.format("a", "")).alias("a"), F.expr(_ASCII.format("b", "")).alias("b"))
    return d.select("doc_id", "line_no", M.error_rate(F.col("a"), F.col("b")).cast("double").alias("cer"))


@query(f"select doc_id, len(string_split(text, chr(10))) as n_lines, length(regexp_replace(text, '[^{X.CJK}]', '', 'g')) as n_cjk, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) as n_letters, length(regexp_replace(text, '[^0-9]', '', 'g')) as n_digits from documents")
def character_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "documents").select("doc_id", *[v.alias(k) for k, v in X.character_counts(F.col("text")).items()])


@query(r"with h as (select page_id, unnest(string_split(html, '>')) as line from pages) select page_id, count(*) filter (where contains(line, '<table')) as html_tables, count(*) filter (where regexp_matches(line, '^\s*\|?[ :\-]*-{3,}[ :\-|]*\|[ :\-|]*$')) as pipe_tables from h group by page_id")
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.table(spark, sf_dir, "pages").select("page_id", F.explode(F.split("html", ">")).alias("line"))
    return M.table_counts(d, ["page_id"])


# ---- paths, geometry ------------------------------------------------------------------------------------------------

_PATH = "case doc_id % 7 when 0 then source || '/' || doc_id || '.PDF' when 1 then source || '/~$' || doc_id || '.docx' when 2 then source || '/a.b/' || doc_id || '.md' when 3 then source || '/' || doc_id || '.ofd.tmp' when 4 then source || '/' || doc_id || '.xlsx' when 5 then source || '/' || doc_id else source || '/' || doc_id || '.txt' end"


@query(f"with p as (select doc_id, {_PATH} as path from documents), q as (select *, regexp_extract(path, '[^/]+$', 0) as name from p) select doc_id, path from q where lower(regexp_extract(name, '\\.([^./]+)$', 1)) in {S.SUPPORTED} and not (name like '%.tmp' or name like '%.crdownload' or name like '~$%')")
def supported_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.table(spark, sf_dir, "documents").select("doc_id", F.expr(_PATH).alias("path"))
    return d.where(files.is_supported(F.col("path")))


@query(f"with p as (select doc_id, {_PATH} as path from documents), q as (select doc_id, substr(path, length(regexp_extract(path, '^[^/]+/', 0)) + 1) as rel from p) select doc_id, case when rel like '%.md' then rel || '.md' when regexp_matches(rel, '[^/]\\.[^./]*$') then regexp_replace(rel, '\\.[^./]*$', '.md') else rel || '.md' end as out from q")
def output_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.table(spark, sf_dir, "documents").select("doc_id", F.expr(_PATH).alias("path"))
    return d.select("doc_id", files.output_name(F.regexp_extract("path", "^[^/]+/", 0), F.col("path")).alias("out"))


@query("with c as (select doc_id, case doc_id % 4 when 0 then encode('%PDF-1.7 ' || source) when 1 then encode('PK' || chr(3) || chr(4)) when 2 then encode('%P') else encode(text) end as content from documents) select doc_id, case when octet_length(content) < 4 then 'error' when hex(content)[1:8] = '25504446' then 'pdf' when hex(content)[1:8] = '504B0304' then 'zip' else 'other' end as kind from c")
def detect_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.expr("case doc_id % 4 when 0 then cast('%PDF-1.7 ' || source as binary) when 1 then X'504B0304' when 2 then cast('%P' as binary) else cast(text as binary) end")
    return A.table(spark, sf_dir, "documents").select("doc_id", F.coalesce(files.magic(c), F.lit("error")).alias("kind"))


@query("with a as (select event_id, event_id % 360 as deg, cos(radians(event_id % 360)) as c, sin(radians(event_id % 360)) as s from events), r as (select event_id, deg, (degrees(atan2(s, c)) + 360) % 90 as r from a) select event_id, least(r, 90 - r) > 12.000000001 as dropped from r")
def watermark_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    deg = F.radians(F.col("event_id") % 360)
    ctm = F.array(F.cos(deg), F.sin(deg), -F.sin(deg), F.cos(deg), F.lit(0.0), F.lit(0.0))
    return A.table(spark, sf_dir, "events").select("event_id", G.off_axis(ctm).alias("dropped"))


@query("select event_id, round(case when event_id % 5 > 0 then 18 + 2 * value + 0.5 * user_id + 3 else 18 + value end, 6) as x, round(case when event_id % 5 > 0 then 29 + 0 * value + 1.5 * user_id + 4 else 29 + user_id end, 6) as y from events")
def affine_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctm = F.when(F.col("event_id") % 5 > 0, F.array(*[F.lit(v) for v in (2.0, 0.0, 0.5, 1.5, 3.0, 4.0)]))
    x, y = G.affine(F.lit(18.0), F.lit(29.0), ctm, F.col("value"), F.col("user_id").cast("double"))
    return A.table(spark, sf_dir, "events").select("event_id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query("""with d as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity * 37 as w, l_partkey % 3000 + 1 as h from lineitem)
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(case when greatest(w, h) <= 1200 then w else greatest(1, round(w * 1200 / greatest(w, h))) end as integer) as w, cast(case when greatest(w, h) <= 1200 then h else greatest(1, round(h * 1200 / greatest(w, h))) end as integer) as h from d""")
def downscale_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = G.downscaled(F.col("l_quantity") * 37, (F.col("l_partkey") % 3000 + 1).cast("double"), F.lit(100))
    return A.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", w.alias("w"), h.alias("h"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to Markdown: words divided at line ends joined, letters to half width, headings found, rendered."""
    d = L.merge_hyphens(A.document_lines(spark, sf_dir, A.NUMBERED), _KEY, "line_no")
    d = d.select("doc_id", F.lit("pdf").alias("source"), F.lit("body").alias("kind"), F.col("line_no").alias("pos"), X.title_prefixed(X.half_width(F.col("line"))).alias("text"))
    s = P.render_pages(d, _KEY).select("doc_id", F.lit(0).alias("page"), F.lit(0).alias("pos"), "segment")
    return P.render_documents(s, "doc_id", "page", "pos")


from . import recognised as _recognised  # noqa: E402,F401 - its queries register themselves
