"""More queries on the driver's tables: recognised pages, precedence, rendering and small text rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import text as X
from ..operators import blocks as B
from ..operators import columns as C
from ..operators import furniture as U
from ..operators import grid as D
from ..operators import metrics as M
from ..operators import pages as P
from ..operators import recognised as Z
from ..operators import routing as R
from . import adapters as A
from .catalog import _TALL, QUERIES, WS, _level, _lstrip, _rstrip, _strip, _tall, query

_KEY = ["doc_id"]
_PAGE = ["doc", "page"]

# ---- furniture by place ---------------------------------------------------------------------------------------------

_PLACED = [
    "l_suppkey % 7 as doc", "cast(l_orderkey % 25 + 1 as integer) as page", f"cast(row_number() over ({A._ORDER}) as bigint) + l_orderkey * 10 as idx",
    "cast((l_partkey % 2) * 250 as float) as x", "cast(30 + l_linenumber as float) as width", "cast(700 - l_linenumber * 90 + (cast(l_quantity as integer) % 3) * 0.3 as float) as y", "cast(10 as float) as height",
    "l_returnflag || cast(l_partkey % 20 as varchar(9)) as text",
]
_BINS = f"""i as (select {', '.join(_PLACED)} from lineitem), m as (select *, greatest(max(x + width) over w, cast(1 as float)) as mx, greatest(max(y + height) over w, cast(1 as float)) as my from i window w as (partition by doc, page)),
    b as (select doc, page, idx, text, cast(trunc(cast((x + width * cast(0.5 as float)) / mx as float) * cast(100 as float)) as integer) as x_bin, cast(trunc(cast((y + height * cast(0.5 as float)) / my as float) * cast(100 as float)) as integer) as y_bin from m)"""


@query(f"""with {_BINS}, n as (select doc, max(page) as pages from b group by doc), k as (select b.doc, text, x_bin, y_bin from b join n on n.doc = b.doc group by b.doc, text, x_bin, y_bin, pages having count(distinct page) >= greatest(3, ceil(cast(pages as float) * cast(0.6 as float))))
    select doc, page, idx, text, x_bin, y_bin from b where not exists (select 1 from k where k.doc = b.doc and k.text = b.text and k.x_bin = b.x_bin and k.y_bin = b.y_bin)""")
def furniture_binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = U.binned(A.table(spark, sf_dir, "lineitem").selectExpr(*_PLACED), "doc", "page")
    return U.strip_furniture(t, "doc", "page", "text", ["x_bin", "y_bin"]).select("doc", "page", "idx", "text", "x_bin", "y_bin")


# ---- precedence and routing -----------------------------------------------------------------------------------------


@query("""select page_id, 'pdf' as source, case when page_id % 5 = 0 then 'grid' when page_id % 3 = 0 then 'pre_rendered' else 'body' end as kind, cast(n as bigint) as pos, url || n as text
    from pages, (values (0), (1)) v(n) where n = 0 or (page_id % 5 > 0 and page_id % 3 > 0)""")
def pdf_page_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.table(spark, sf_dir, "pages")
    level = lambda on, kind, n: p.where(on).select("page_id", F.lit("pdf").alias("source"), F.lit(kind).alias("kind"), F.lit(n).cast("long").alias("pos"), F.concat("url", F.lit(str(n))).alias("text"))
    return P.page_content(["page_id"], level("page_id % 5 = 0", "grid", 0), level("page_id % 3 = 0", "pre_rendered", 0), level("true", "body", 0).unionByName(level("true", "body", 1)))


@query("""with t as (select l_orderkey as doc_id, l_linenumber as line_no, count(*) as k from lineitem group by l_orderkey, l_linenumber), s as (select o_orderkey as doc_id, o_orderkey % 2 as kept from orders)
    select p.o_orderkey as doc_id from orders p where o_orderkey % 3 > 0 and exists (select 1 from s where s.doc_id = p.o_orderkey and kept = 0)""")
def render_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"))
    return R.render_subset(o.where("doc_id % 3 > 0"), o.where("doc_id % 2 = 0").unionByName(o.where("doc_id % 4 = 0")), _KEY)


#: many items a page, on some pages at two places only
_CROWDED = ["l_orderkey % 600 as doc_id", "cast(l_linenumber as integer) as line_no", f"cast(row_number() over ({A._ORDER}) + l_orderkey * 10 as integer) as item_idx", "cast((l_partkey % (2 + l_orderkey % 3)) * 150 as double) as x", "cast(100 as double) as width"]


@query(f"""with t as (select {', '.join(_CROWDED)} from lineitem), g as (select *, lag(x + width) over (partition by doc_id, line_no order by x, item_idx) as e, max(x + width) over (partition by doc_id) as pw from t),
    s as (select doc_id, line_no, count(*) filter (where x - e > pw * 0.01) + 1 as s from g group by doc_id, line_no) select doc_id from s where doc_id in (select o_orderkey % 600 from orders where o_orderpriority = '1-URGENT') group by doc_id having count(*) filter (where s >= 3) >= 3""")
def suspicious_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.suspicious_pages(A.table(spark, sf_dir, "lineitem").selectExpr(*_CROWDED), A.table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").selectExpr("o_orderkey % 600 as doc_id"), _KEY)


@query(f"with m as (select user_id, max(event_id) as event_id from events group by user_id) select c.conv_id as user_id, event_id, chr(10) || {_strip('c.text')} || chr(10) as text from conversations c join m on m.user_id = c.conv_id where c.turn = 0 and {_strip('c.text')} <> ''")
def last_page_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    probed = A.table(spark, sf_dir, "conversations").where("turn = 0").select(F.col("conv_id").alias("user_id"), "text")
    return R.last_page_tables(probed, A.table(spark, sf_dir, "events"), "user_id", "event_id", "text")


@query("select l_orderkey as doc_id from lineitem group by l_orderkey having count(*) filter (where l_returnflag = 'R') > 0")
def table_confirmation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as doc_id", "case when l_returnflag = 'R' then 'table' else 'text' end as element_type")
    return R.confirmed_tables(e, _KEY)


@query("select doc_id, source as error from documents where doc_id % 3 = 0")
def document_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.document_errors(A.table(spark, sf_dir, "documents").select("doc_id", F.expr("case when doc_id % 3 > 0 then 7 end").alias("page"), F.col("source").alias("error")))


# ---- text -----------------------------------------------------------------------------------------------------------


@query("select page_id, regexp_replace(url, '[^A-Za-z0-9._-]', '_', 'g') as name from pages")
def snapshot_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "pages").select("page_id", X.snapshot_name(F.col("url")).alias("name"))


_MARKDOWN = "case line_no % 10 when 0 then '![x](y)' when 1 then '## ' || line when 2 then '| ' || line || ' | b |' when 3 then '|:--|---|' when 4 then ' 12 ' when 5 then '- ' || line when 6 then '> ' || line when 7 then line || '.....7' when 8 then '' else line end"
_PLAIN = f"""regexp_replace(regexp_replace(regexp_replace({_strip('line')}, '^#{{1,6}}\\s+|^[-*+]\\s+|^>\\s*', ''), '\\|', ' ', 'g'), '[.…·]{{3,}}', ' ', 'g')"""


@query(f"""with {A.LINES}, n as (select doc_id, line_no, {_MARKDOWN} as line from l) select doc_id, line_no, case when regexp_matches({_strip('line')}, '^!\\[') or regexp_matches({_strip('line')}, '^[|:\\- ]+$') or regexp_matches({_strip('line')}, '^[0-9]{{1,3}}$') or {_strip(_PLAIN)} = '' then null else {_strip(_PLAIN)} end as plain from n""")
def plain_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.document_lines(spark, sf_dir, _MARKDOWN).select("doc_id", "line_no", X.plain_line(F.col("line")).alias("plain"))


@query("select doc_id, case when doc_id % 4 > 1 then ' colspan=\"' || doc_id % 4 || '\"' else '' end || case when doc_id % 3 > 1 then ' rowspan=\"' || doc_id % 3 || '\"' else '' end as attributes from documents")
def span_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "documents").select("doc_id", X.span_attributes((F.col("doc_id") % 4).cast("int"), (F.col("doc_id") % 3).cast("int")).alias("attributes"))


_ENDED = f"case line_no % 3 when 0 then substr({A.NUMBERED}, 1, 30) || '。' when 1 then substr({A.NUMBERED}, 1, 45) else substr(line, 1, 20) end"


@query(f"with {A.LINES}, n as (select doc_id, line_no, {_ENDED} as line from l) select doc_id, line_no, cast(coalesce({_level(_strip('line'))}, case when length({_strip('line')}) between 1 and {S.HINT_MAX} and not regexp_matches({_strip('line')}, '[。，；：]$') then 2 end) as integer) as level from n")
def hint_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.document_lines(spark, sf_dir, _ENDED).select("doc_id", "line_no", X.hint_level(F.col("line")).alias("level"))


_POST = "case line_no % 4 when 1 then line || '-' when 2 then translate(lower(line), 'aeT0.', 'ａｅＴ０．') when 3 then line || '- ' else line end"


@query(f"""with {A.LINES}, n as (select doc_id, line_no, {_POST} as line from l),
    k as (select *, coalesce({_rstrip('lag(line) over w')} like '%-' and regexp_matches({_lstrip('line')}, '^[a-z]'), false) as taken from n window w as (partition by doc_id order by line_no)),
    g as (select *, coalesce(lead(taken) over w, false) as gives, sum(case when taken then 0 else 1 end) over (partition by doc_id order by line_no rows unbounded preceding) as run from k window w as (partition by doc_id order by line_no)),
    o as (select doc_id, run, line_no, case when taken then {_lstrip('line')} else line end as t, gives from g)
    select doc_id, min(line_no) as line_no, translate(string_agg(case when gives then regexp_replace(t, '-{WS}*$', '') else t end, '' order by line_no), '{X.FULL}', '{X.HALF}') as line from o group by doc_id, run""")
def postprocessed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import lines as L

    return L.merge_hyphens(A.document_lines(spark, sf_dir, _POST), _KEY, "line_no").withColumn("line", X.half_width(F.col("line")))


# ---- rendering ------------------------------------------------------------------------------------------------------

_KINDS = ("body", "body", "pre_rendered", "table_html", "table_html", "grid")
_ROW = "case when line_no % 6 in (2, 3) and line_no % 4 = 1 then line || chr(10) || chr(10) else line end"
_SOURCE = "case doc_id % 3 when 0 then 'ofd' when 1 then 'pdf' else 'ocr' end"
_RANK = "case when k in (0, 1) then 0 when k = 2 then 1 when k in (3, 4) then 2 else 3 end"


@query(f"""with {A.LINES}, n as (select doc_id, {_SOURCE} as source, line_no, line_no % 6 as k, {_ROW} as t from l where line_no < 12), v as (select doc_id, source, list({{'r': {_RANK}, 't': t}} order by {_RANK}, line_no) as v from n where k not in (3, 4) or source = 'ocr' group by doc_id, source)
    select doc_id, list_reduce(list_transform(v, lambda x : {{'s': '', 'r': x.r, 't': x.t}}), lambda a, x : {{'s': a.s || case
        when x.r = 0 and source = 'ofd' then case when a.r >= 0 then chr(10) else '' end || x.t
        when x.r = 0 then case when x.t like '#%' and a.s <> '' and right(a.s, 2) <> chr(10) || chr(10) then chr(10) else '' end || x.t || case when x.t like '#%' then chr(10) || chr(10) else chr(10) end
        when x.r = 1 then x.t when x.r = 2 then case when right(a.s, 2) <> chr(10) || chr(10) then chr(10) || chr(10) else '' end || x.t
        when source = 'ocr' then chr(10) || chr(10) || x.t || chr(10) else x.t || chr(10) || chr(10) end, 'r': x.r, 't': ''}}, {{'s': '', 'r': -1, 't': ''}}).s as segment from v""")
def render_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.document_lines(spark, sf_dir, _ROW).where("line_no < 12")
    kind = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (F.col("line_no") % 6 + 1).cast("int"))
    return P.render_pages(d.select("doc_id", F.expr(_SOURCE).alias("source"), kind.alias("kind"), F.col("line_no").cast("long").alias("pos"), F.col("line").alias("text")), _KEY)


@query("""with w as (select user_id, event_type, floor(value) as value from events where value is not null), s as (select user_id, coalesce(sum(value) filter (where event_type = 'click'), 0) as a, coalesce(sum(value) filter (where event_type = 'view'), 0) as b from w group by user_id), v as (select event_type, list_sort(list(value)) as v from w group by event_type)
    select 0 as part, cast(user_id as varchar) as key, format('page {} click={:.1f} view={:.1f} total={:.1f}', user_id, a, b, a + b) as line from s
    union all select 1, event_type, format('{} n={} p50={:.1f} p95={:.1f} max={:.1f}', event_type, len(v), v[len(v) // 2 + 1], v[cast(least(greatest(ceil(len(v) * 95 / 100) - 1, 0), len(v) - 1) as integer) + 1], list_max(v)) from v""")
def timing_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.timing_report(A.table(spark, sf_dir, "events").where("value is not null").withColumn("value", F.floor("value").cast("double")), "user_id", "event_type", "value", ["click", "view"])


@query()
def sequence_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MET-3, MET-9: matching blocks have no SQL; the tests hold the scores against a plain version."""
    d = A.table(spark, sf_dir, "pages").select("page_id", M.sequence_scores(F.col("url"), F.col("html")).alias("s"))
    return d.select("page_id", "s.*")


# ---- blocks ---------------------------------------------------------------------------------------------------------

#: Layout of each order: three boxes with an order on every second page, and two of noise.
_ELEMENTS = "(values (0, 'text', 2, 0.0, 300.0, 0.0, 62.0), (1, 'text', 1, 0.0, 1000.0, 41.0, 103.0), (2, 'title', 3, 480.0, 560.0, 0.0, 200.0), (3, 'header', 0, 400.0, 700.0, 0.0, 66.0), (4, 'number', cast(null as integer), 0.0, 120.0, 110.0, 400.0)) as v(el_idx, element_type, order_index, x_min, x_max, y_min, y_max)"
_EL = "el_idx, element_type, {} as order_index, cast(x_min as double) as x_min, cast(x_max as double) as x_max, cast(y_min as double) as y_min, cast(y_max as double) as y_max"
_E = f"e as (select o_orderkey as doc_id, {_EL.format('case when o_orderkey % 2 = 0 then order_index end')} from orders, {_ELEMENTS})"
_BLOCKS = "(values (0, 2, [0, 3]), (1, 1, [2, 1]), (2, cast(null as integer), [0])) as v(rb_idx, order_index, element_indices)"


def _elements(spark, sf_dir, ordered="doc_id % 2 = 0"):
    v = spark.sql(f"select {_EL.format('order_index')} from {_ELEMENTS}")
    d = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id")).crossJoin(F.broadcast(v))
    return d.withColumn("order_index", F.when(F.expr(ordered), F.col("order_index")))


def _region_blocks(spark, sf_dir):
    v = spark.sql("select * from (values (0, 2, array(0, 3)), (1, 1, array(2, 1)), (2, cast(null as int), array(0))) as v(rb_idx, order_index, element_indices)")
    return A.table(spark, sf_dir, "orders").where("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("doc_id")).crossJoin(F.broadcast(v))


#: block_rank of what counts: by order on even pages; on odd ones by region blocks, of which every third page has none
_RANKED = f"""{_E}, k as (select doc_id, el_idx, x_min, x_max, y_min, y_max, cast(row_number() over (partition by doc_id order by order_index nulls last, y_min, el_idx) as integer) as block_rank from e where element_type not in ('header', 'number') and doc_id % 2 = 0
    union all select e.doc_id, e.el_idx, x_min, x_max, y_min, y_max, cast(row_number() over (partition by e.doc_id order by b.o, y_min, b.p) as integer) from e join (values (1, 0, 2), (1, 1, 1), (2, 0, 0)) b(o, p, el_idx) on b.el_idx = e.el_idx where e.doc_id % 2 = 1 and e.doc_id % 3 > 0)"""


def _assembled(source: str) -> str:
    """CTEs up to pl (doc_id, block_rank, pos, y_min, text, leftover): claimed regions in order within their block, and leftovers of pages with an order."""
    return f"""sc as (select s.doc_id, max(s.x_max) as tw, max(s.y_max) as th from r s group by s.doc_id), lc as (select doc_id, max(x_max) as lw, max(y_max) as lh from e group by doc_id),
    n as (select s.*, (s.x_min + s.x_max) / 2 / tw as nx, s.y_min / th as ny, lw, lh from {source} s join sc on sc.doc_id = s.doc_id join lc on lc.doc_id = s.doc_id),
    cl as (select n.doc_id, n.region_idx, min(block_rank) as block_rank from n join k on k.doc_id = n.doc_id and nx between k.x_min / lw and k.x_max / lw and ny between k.y_min / lh and k.y_max / lh group by n.doc_id, n.region_idx),
    f as (select n.doc_id, n.region_idx, block_rank, n.x_min, n.x_max, n.y_min, n.text, (n.x_min + n.x_max) / 2 as cx, greatest(max(n.x_max) over (partition by n.doc_id, block_rank), 0) as page_w from n join cl on cl.doc_id = n.doc_id and cl.region_idx = n.region_idx),
    ff as (select *, page_w * 0.92 < x_max - x_min and x_min < page_w * 0.08 as fw from f),
    body as (select doc_id, block_rank, cx, row_number() over w as rn, lag(cx) over w as p, count(*) over (partition by doc_id, block_rank) as nb from ff where not fw window w as (partition by doc_id, block_rank order by cx, region_idx)),
    best as (select * from body where p is not null qualify row_number() over (partition by doc_id, block_rank order by cx - p desc, rn) = 1), tot as (select doc_id, block_rank, count(*) as c, max(page_w) as page_w from ff group by doc_id, block_rank),
    s0 as (select best.doc_id, best.block_rank, (p + cx) / 2 as split from best join tot on tot.doc_id = best.doc_id and tot.block_rank = best.block_rank where c >= 4 and nb >= 4 and page_w > 0 and cx - p > 0 and cx - p >= page_w * 0.03 and rn - 1 >= 2 and nb - (rn - 1) >= 2),
    sp as (select * from s0 where not exists (select 1 from ff where ff.doc_id = s0.doc_id and ff.block_rank = s0.block_rank and not fw and x_min < split and split < x_max)),
    own as (select ff.doc_id, ff.block_rank, cast(row_number() over (partition by ff.doc_id, ff.block_rank order by case when split is null or page_w <= 0 then 0 when fw then 0 when cx < split then 1 else 2 end, y_min, region_idx) as integer) as pos, y_min, text from ff left join sp on sp.doc_id = ff.doc_id and sp.block_rank = ff.block_rank),
    lo as (select n.doc_id, 2147483647 as block_rank, cast(row_number() over (partition by n.doc_id order by n.y_min, n.region_idx) as integer) as pos, n.y_min, n.text from n where n.doc_id % 2 = 0 and not exists (select 1 from cl where cl.doc_id = n.doc_id and cl.region_idx = n.region_idx)
        and not exists (select 1 from e where e.doc_id = n.doc_id and element_type in ('header', 'number') and nx between e.x_min / lw and e.x_max / lw and ny between e.y_min / lh and e.y_max / lh)),
    pl as (select * from own union all select * from lo),
    pg as (select *, abs(y_min - lag(y_min) over (partition by doc_id, block_rank order by pos)) as gap from pl), pm as (select doc_id, block_rank, list_sort(list(gap) filter (where gap is not null)) as v from pg group by doc_id, block_rank),
    pc as (select pg.*, (gap is null or gap > greatest(coalesce(v[len(v) // 2 + 1], 20), 8) * 1.5) as cut from pg join pm on pm.doc_id = pg.doc_id and pm.block_rank = pg.block_rank),
    pr as (select *, sum(case when cut then 1 else 0 end) over (partition by doc_id, block_rank order by pos rows unbounded preceding) as run from pc),
    para as (select doc_id, block_rank, min(pos) as pos, string_agg(text, '' order by pos) as line from pr group by doc_id, block_rank, run)"""


def _last_resort(source: str) -> str:
    """CTEs up to ro (doc_id, pos, line): ORD-3 of the odd pages that have no paragraph."""
    return f"""q0 as (select * from {source} s where doc_id % 2 = 1 and not exists (select 1 from own where own.doc_id = s.doc_id)), q1 as (select *, greatest(max(x_max) over (partition by doc_id), 0) as page_w, (x_min + x_max) / 2 as cx from q0), q2 as (select *, page_w * 0.92 < x_max - x_min and x_min < page_w * 0.08 as fw from q1),
    q3 as (select doc_id, cx, row_number() over w as rn, lag(cx) over w as p, count(*) over (partition by doc_id) as nb from q2 where not fw window w as (partition by doc_id order by cx, region_idx)), q4 as (select * from q3 where p is not null qualify row_number() over (partition by doc_id order by cx - p desc, rn) = 1),
    q5 as (select doc_id, count(*) as c, max(page_w) as page_w from q2 group by doc_id), q6 as (select q4.doc_id, (p + cx) / 2 as split from q4 join q5 on q5.doc_id = q4.doc_id where c >= 4 and nb >= 4 and page_w > 0 and cx - p > 0 and cx - p >= page_w * 0.03 and rn - 1 >= 2 and nb - (rn - 1) >= 2),
    q7 as (select * from q6 where not exists (select 1 from q2 where q2.doc_id = q6.doc_id and not fw and x_min < split and split < x_max)), q8 as (select doc_id, min(y_min) filter (where not fw) as top, max(y_min) filter (where not fw) as bottom from q2 group by doc_id),
    ro as (select q2.doc_id, cast(row_number() over (partition by q2.doc_id order by case when split is null or page_w <= 0 then 0 when not fw then case when cx < split then 1 else 2 end when y_min < top then 0 when y_min > bottom then 4 else 3 end, y_min, region_idx) as integer) as pos, text as line from q2 left join q7 on q7.doc_id = q2.doc_id left join q8 on q8.doc_id = q2.doc_id)"""


def _alike(sql: str, ordered: bool) -> str:
    """The CTEs with every page taken as one of an order, or as one of none."""
    yes, no = ("true", "false") if ordered else ("false", "true")
    sql = sql.replace("case when o_orderkey % 2 = 0 then order_index end", "order_index" if ordered else "cast(null as integer)")
    for page in ("e.doc_id", "n.doc_id", "doc_id"):
        sql = sql.replace(f" {page} % 2 = 0", f" {yes}").replace(f" {page} % 2 = 1", f" {no}")
    return sql


@query(f"with {A.REGIONS}, {_alike(_RANKED, True)}, {_alike(_assembled('r'), True)} select doc_id, block_rank, pos, line from para")
def block_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.assemble(A.regions(spark, sf_dir), _elements(spark, sf_dir, "true"), _KEY)


@query(f"with {A.REGIONS}, {_alike(_RANKED, False)}, {_alike(_assembled('r'), False)}, {_alike(_last_resort('r'), False)} select doc_id, block_rank, pos, line from para union all select doc_id, 0, pos, line from ro")
def fallback_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.fallback_order(A.regions(spark, sf_dir), _elements(spark, sf_dir, "false"), _region_blocks(spark, sf_dir), _KEY)


#: half of the regions are tall and narrow
_MIXED = "select doc_id, region_idx, x_min, case when region_idx % 2 = 0 then x_min + 4 + region_idx % 5 else x_max end as x_max, y_min, case when region_idx % 2 = 0 then y_min + 60 else y_max end as y_max, case when region_idx % 8 = 0 then ' ' || chr(12288) else text end as text from r0"


def _mixed(spark, sf_dir):
    d = A.regions(spark, sf_dir)
    tall = F.col("region_idx") % 2 == 0
    return d.select("doc_id", "region_idx", "x_min", F.when(tall, F.col("x_min") + 4 + F.col("region_idx") % 5).otherwise(F.col("x_max")).alias("x_max"), "y_min", F.when(tall, F.col("y_min") + 60).otherwise(F.col("y_max")).alias("y_max"), F.when(F.col("region_idx") % 8 == 0, F.lit(" 　")).otherwise(F.col("text")).alias("text"))


_VERTICAL = """vc as (select *, x_max - x_min as w, (x_min + x_max) / 2 as cx, greatest(max(x_max) over (partition by doc_id), 0) as pw from r), vk as (select * from vc where y_max - y_min > greatest(w, 1) * 2.5 and greatest(w, 1) < pw * 0.4),
    va as (select doc_id, list({'cx': cx, 'i': region_idx, 'w': w, 'y': y_min, 't': text, 'a': cast(null as double), 'g': 0} order by cx, region_idx) as v from vk group by doc_id),
    vq as (select doc_id, list_reduce(list_transform(v, lambda x : [x]), lambda p, x : list_append(p, struct_update(x[1], a := case when p[-1].a is not null and abs(p[-1].a - x[1].cx) <= greatest(x[1].w * 1.5, 6) then p[-1].a else x[1].cx end, g := case when p[-1].a is not null and abs(p[-1].a - x[1].cx) <= greatest(x[1].w * 1.5, 6) then p[-1].g else p[-1].g + 1 end)), [{'cx': 0.0, 'i': 0, 'w': 0.0, 'y': 0.0, 't': '', 'a': cast(null as double), 'g': 0}]) as o from va),
    vu as (select doc_id, unnest(o[2:]) as z from vq), vt as (select doc_id, z.g as g, z.a as a, regexp_replace(string_agg(STRIP, chr(10) order by z.y, z.cx, z.i), '^\\n+', '') as line from vu group by doc_id, z.g, z.a),
    flat as (select * from r where not exists (select 1 from vk where vk.doc_id = r.doc_id and vk.region_idx = r.region_idx))""".replace("STRIP", _strip("z.t"))


@query(f"""with {A.REGIONS.replace('r as', 'r0 as', 1)}, r as ({_MIXED}), {_VERTICAL}, {_RANKED}, {_assembled('flat')}, {_last_resort('flat')},
    al as (select doc_id, 0 as s, row_number() over (partition by doc_id order by a desc, g) as b, 0 as pos, line from vt where line <> '' union all select doc_id, 1, block_rank, pos, line from para union all select doc_id, 1, 0, pos, line from ro)
    select doc_id, cast(row_number() over (partition by doc_id order by s, b, pos) as integer) as pos, line from al""")
def order_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.order_structure(_mixed(spark, sf_dir), _elements(spark, sf_dir), _region_blocks(spark, sf_dir).where("doc_id % 2 = 1"), _KEY)


# ---- grids ----------------------------------------------------------------------------------------------------------

_CELLS = "select conv_id, cast(turn // 2 as integer) as row, cast(turn % 2 as integer) as col, case when length(text) % 3 > 0 then substr(text, 1, 5) end as text, 10.0 + (turn % 2) * 50 as x_min, 30.0 + (turn % 2) * 50 as x_max, 20.0 * (turn // 2) as y_min, 20.0 * (turn // 2) + 8 as y_max from conversations qualify row_number() over (partition by conv_id, turn order by text) = 1"
_FILL = "select conv_id, turn as region_idx, 20.0 + (turn % 2) * 50 as x, 20.0 * (turn // 2) + length(text) % 30 as y, role || turn as t from conversations qualify row_number() over (partition by conv_id, turn order by text) = 1"


@query(f"""with c as ({_CELLS}), q as ({_FILL}), z as (select conv_id, max(row) + 1 as n_rows, max(col) + 1 as cols from c group by conv_id having max(row) >= 1 and max(col) >= 1),
    f as (select c.conv_id, row, col, arg_min(q.t, q.region_idx) as t from c join q on q.conv_id = c.conv_id and abs(q.x - (x_min + x_max) / 2) <= 8 and abs(q.y - y_min) <= 12 where coalesce(c.text, '') = '' group by c.conv_id, row, col),
    g as (select z.conv_id, r.r, k.k from z, (select unnest(range(500)) as r) r, (select unnest(range(2)) as k) k where r < n_rows and k < cols),
    t as (select g.conv_id, r, k, case when coalesce(c.text, '') = '' then coalesce(f.t, '') else c.text end as t from g left join c on c.conv_id = g.conv_id and row = r and col = k left join f on f.conv_id = g.conv_id and f.row = r and f.col = k)
    select conv_id, cast(r as integer) as row, string_agg(t, '|' order by k) as texts from t group by conv_id, r""")
def structure_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.row_number().over(W.partitionBy("conv_id", "turn").orderBy("text"))
    d = A.table(spark, sf_dir, "conversations").withColumn("n", first).where("n = 1")
    row, col = F.expr("cast(turn div 2 as int)"), (F.col("turn") % 2).cast("int")
    c = d.select("conv_id", row.alias("row"), col.alias("col"), F.expr("case when length(text) % 3 > 0 then substr(text, 1, 5) end").alias("text"), (10.0 + col * 50).alias("x_min"), (30.0 + col * 50).alias("x_max"), (20.0 * row).alias("y_min"), (20.0 * row + 8).alias("y_max"))
    x, y = 20.0 + col * 50, 20.0 * row + F.length("text") % 30
    r = d.select("conv_id", F.col("turn").alias("region_idx"), x.alias("x_min"), x.alias("x_max"), y.alias("y_min"), y.alias("y_max"), F.concat("role", F.col("turn").cast("string")).alias("text"))
    g = D.from_structure(c, ["conv_id"], r)
    return g.select("conv_id", F.posexplode(F.concat(F.array("header"), F.col("rows"))).alias("row", "r")).select("conv_id", "row", F.array_join(F.transform("r", lambda v: v["text"]), "|").alias("texts"))


_GUARD = "case l_linenumber % 4 when 0 then 'image' when 1 then case when l_suppkey % 3 = 0 then 'figure_title' else 'text' end when 2 then case when l_suppkey % 2 = 0 then 'table_title' else 'text' end else 'text' end"


@query(f"with e as (select l_orderkey as doc_id, {_GUARD} as t from lineitem) select doc_id, count(*) filter (where t = 'image') > 0 and not (count(*) filter (where t = 'figure_title') > 0 and count(*) filter (where t = 'table_title') = 0) as tried from e group by doc_id")
def image_table_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as doc_id", f"{_GUARD} as element_type")
    return D.image_guard(e, _KEY)


@query()
def image_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images over the left or the right half of a page; held against a plain version in the tests, as its grids have no SQL of bearable length."""
    r = A.regions(spark, sf_dir)
    e = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.expr("case when o_orderkey % 7 = 0 then 'figure_title' else 'image' end").alias("element_type"), F.lit(0.0).alias("x_min"), F.expr("case when o_orderkey % 3 = 0 then 400.0D else 1200.0D end").alias("x_max"), F.lit(0.0).alias("y_min"), F.lit(160.0).alias("y_max"))
    g = D.image_tables(r, e.withColumn("el_idx", F.lit(0)), _KEY)
    return g.select("doc_id", "cols", "has_header", F.size("rows").alias("n_rows"), D.to_html(g).alias("html"))


# ---- whole grids ----------------------------------------------------------------------------------------------------


def _rows(p: str, tol: str, gap: str) -> str:
    """CTEs from {p}t (doc_id, pw, ...) to {p}c: cells of pages of four regions and more, rows by ``tol`` and cells by ``gap``."""
    one = "{'y': y_min, 'i': region_idx, 'a': cast(null as double), 'g': 0}"
    same = "p[-1].a is not null and abs(p[-1].a - x[1].y) <= tol"
    return f"""{p}v as (select r.doc_id, any_value({tol}) as tol, list({one} order by y_min, region_idx) as v from r join {p}t t on t.doc_id = r.doc_id group by r.doc_id),
    {p}w as (select doc_id, list_reduce(list_transform(v, lambda x : [x]), lambda p, x : list_append(p, struct_update(x[1], a := case when {same} then p[-1].a else x[1].y end, g := case when {same} then p[-1].g else p[-1].g + 1 end)), [{{'y': 0.0, 'i': 0, 'a': cast(null as double), 'g': 0}}]) as o from {p}v),
    {p}u as (select doc_id, unnest(o[2:]) as z from {p}w), {p}r as (select r.*, z.g as row_no, {gap} as gap from {p}u u join r on r.doc_id = u.doc_id and r.region_idx = z.i join {p}t t on t.doc_id = r.doc_id),
    {p}x as (select *, coalesce(x_min - lag(x_max) over w > gap, true) as cut from {p}r window w as (partition by doc_id, row_no order by x_min, region_idx)),
    {p}y as (select *, sum(case when cut then 1 else 0 end) over (partition by doc_id, row_no order by x_min, region_idx rows unbounded preceding) as cell_no from {p}x),
    {p}c as (select doc_id, row_no, cell_no, arg_min(x_min, {{'x': x_min, 'i': region_idx}}) as x, arg_min(y_min, {{'x': x_min, 'i': region_idx}}) as y, string_agg(text, ' ' order by x_min, region_idx) as text from {p}y group by doc_id, row_no, cell_no)"""


#: regions with some pitch, wide enough apart to make cells
_SPREAD = A.REGIONS.replace("cast(l_linenumber * 20", "cast(l_linenumber * (10 + l_orderkey % 4 * 6)")
_TOLERANCE = f"""{_SPREAD}, big as (select doc_id from r group by doc_id having count(*) >= 4),
    q1t as (select r.doc_id, greatest(max(x_max), 0) as pw, list_sort(list(y_max - y_min)) as hs from r join big on big.doc_id = r.doc_id group by r.doc_id), {_rows('q1', 'greatest(hs[len(hs) // 2 + 1] * 0.8, 2)', 'pw * 0.012')},
    al as (select doc_id, row_no, avg(y) as c from q1c group by doc_id, row_no), ad as (select doc_id, abs(c - lag(c) over (partition by doc_id order by row_no)) as d from al), ap as (select doc_id, list_sort(list(d) filter (where d is not null)) as v from ad group by doc_id),
    q2t as (select q1t.doc_id, pw, least(greatest(coalesce(v[len(v) // 2 + 1], 12) * 0.5, 4), greatest(pw * 0.3, 4)) as row_tol from q1t join ap on ap.doc_id = q1t.doc_id)"""


def _spread(spark, sf_dir):
    return A.lineitem(spark, sf_dir).selectExpr(*[c.replace("cast(l_linenumber * 20", "cast(l_linenumber * (10 + l_orderkey % 4 * 6)") for c in A.REGION_COLUMNS])


@query(f"with {_TOLERANCE} select doc_id, pw as page_w, row_tol from q2t")
def row_tolerances(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _spread(spark, sf_dir)
    return D.row_tolerance(r.withColumn("n", F.count("*").over(W.partitionBy("doc_id"))).where("n >= 4").drop("n"), _KEY)


_HEADER = "|".join(S.HEADER_WORDS)


def _is_header(h: str, b: str) -> str:
    mean = lambda v: f"coalesce(list_sum(list_transform({v}, lambda t : length(t))), 0) / greatest(len({v}), 1)"
    return f"(regexp_matches(array_to_string({h}, ''), '{_HEADER}') or (len({b}) > 0 and {mean(h)} <= 5 and {mean(b)} > {mean(h)} * 1.8))"


@query(f"""with {_TOLERANCE}, {_rows('q2', 'row_tol', 'pw * 0.012')}, na as (select doc_id, row_no, count(*) as k from q2c group by doc_id, row_no), nb as (select doc_id, k from na where k >= 2 group by doc_id, k having count(*) >= 2), cols as (select doc_id, max(k) as cols from nb group by doc_id),
    xa as (select c.doc_id, c.cell_no - 1 as col, list_sort(list(x)) as v from q2c c join na on na.doc_id = c.doc_id and na.row_no = c.row_no join cols on cols.doc_id = c.doc_id where k = cols.cols group by c.doc_id, c.cell_no - 1), cent as (select doc_id, col, v[len(v) // 2 + 1] as center from xa),
    pa as (select c.*, p.col, row_number() over (partition by c.doc_id, c.row_no, c.cell_no order by abs(x - center), p.col) as n from q2c c join na on na.doc_id = c.doc_id and na.row_no = c.row_no and k >= 2 join cent p on p.doc_id = c.doc_id),
    placed as (select * from pa where n = 1 qualify row_number() over (partition by doc_id, row_no, col order by text = '', x, cell_no) = 1), f as (select *, min(row_no) over (partition by doc_id) as first from placed),
    ac2 as (select f.doc_id, col, max(x) filter (where row_no > first and text <> '') - min(x) filter (where row_no > first and text <> '') as d, any_value(greatest(pw * 0.02, 10)) as t from f join q2t on q2t.doc_id = f.doc_id group by f.doc_id, col),
    ok as (select doc_id from ac2 group by doc_id having bool_and(d is null or d <= t)), full_ as (select ok.doc_id, w.row_no, cols, k.k as col from ok join cols on cols.doc_id = ok.doc_id join (select distinct doc_id, row_no from placed) w on w.doc_id = ok.doc_id, (select unnest(range(50)) as k) k where k.k < cols),
    g as (select full_.*, coalesce(p.text, '') as text, min(full_.row_no) over (partition by full_.doc_id) as first from full_ left join placed p on p.doc_id = full_.doc_id and p.row_no = full_.row_no and p.col = full_.col),
    o as (select doc_id, any_value(cols) as cols, list(text order by col) filter (where row_no = first) as h, coalesce(list(text order by row_no, col) filter (where row_no > first), []) as b from g group by doc_id)
    select doc_id, cast(cols as integer) as cols, {_is_header('h', 'b')} as has_header, array_to_string(h, '|') as header, array_to_string(b, '|') as body from o""")
def grid_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = D.reconstruct(_spread(spark, sf_dir), _KEY)
    text = lambda v: F.array_join(F.transform(v, lambda c: c["text"]), "|")
    return g.select("doc_id", "cols", "has_header", text(F.col("header")).alias("header"), text(F.flatten("rows")).alias("body"))


_H, _B = "string_split(split_part(text, chr(10), 1) || case when doc_id % 7 = 0 then '编号' else '' end, ' ')", "string_split(text, '.')"


@query(f"select doc_id, {_is_header(_H, _B)} as header from documents")
def header_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.split(F.concat(F.split_part("text", F.lit("\n"), F.lit(1)), F.when(F.col("doc_id") % 7 == 0, "编号").otherwise("")), " ")
    return A.table(spark, sf_dir, "documents").select("doc_id", D.is_header(h, F.split("text", r"\.")).alias("header"))
