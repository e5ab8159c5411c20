"""Named queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chat as C
from ..functions import pairs
from ..functions import text as T
from ..operators import features, metrics, ordering, runs, sampling, split, tail, tree, validate
from ..sources import binary, records, sinks
from ..sources.storage import exists, shared_dir, written
from . import fixtures as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
EOS = "<|end|>"


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if it has one."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


# ---- SQL building blocks (decks of orders, chats) ----

_LINES = """lines as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
  case when {mono} and row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1 then 'mono'
       when p_size <= 2 then 'tiny_' || lower(split_part(p_type, ' ', 1)) else lower(split_part(p_type, ' ', 1)) end as kind,
  p_brand as nm, cast(cast(l_quantity as int) as varchar) as q from lineitem join part on l_partkey = p_partkey)"""
_DECKS = (
    "with "
    + _LINES.format(mono="true")
    + """, decks as (select l_orderkey as seq, string_agg(kind || ' ' || nm || ' ' || q, chr(10)
  order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, kind) as deck,
  list(kind order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, kind) as ks from lines group by 1),
uniq as (select seq, deck, ks from decks qualify row_number() over (partition by deck order by seq) = 1),
signed as (select seq, deck, array_to_string(list_sort(list_distinct(ks)), ',') as sig, array_to_string(ks, ',') as sig_fine,
  ('0x' || substr(sha1(deck), 1, 8))::bigint % 100 as h from uniq),
kindsig as (select distinct sig, unnest(string_split(sig, ',')) as kind from signed),
prot as (select distinct min(sig) as sig from kindsig group by kind having count(*) = 1),
heldout as (select sig, ('0x' || substr(sha1(sig), 1, 8))::bigint as sig_hash from (select distinct sig from signed)
  where sig not in (select sig from prot) order by 2, 1 limit 8),
parts as (select signed.*, case when sig in (select sig from heldout) then 'test_b' when h < 12 then 'test_a' when h < 17 then 'val' else 'train' end as split from signed)
"""
)
_PAIRS = (
    "with "
    + _LINES.format(mono="false")
    + """, gold as (select distinct l_orderkey as seq, kind from lines),
pred as (select distinct l_orderkey as seq, case when l_suppkey % 11 = 0 then 'ghost' else kind end as kind from lines where l_partkey % 10 <> 0),
hits as (select kind, count(g) as gold, count(p) as pred, count(case when g is not null and p is not null then 1 end) as hit from
  (select coalesce(gold.kind, pred.kind) as kind, gold.kind as g, pred.kind as p from gold full join pred on gold.seq = pred.seq and gold.kind = pred.kind) group by 1),
parts as (select kind, gold as n, case when gold < 1000 then 'tail' else 'head' end as part from hits where gold > 0)
"""
)
_CHATS = """with c as (select conv_id, list(struct_pack(role := role, content := text) order by turn) as m from conversations group by 1),
t as (select *, list_filter(m, lambda x: x.role = 'assistant') as a, list_filter(m, lambda x: x.role = 'user') as u from c)
"""
_THINK = """with r as (select conv_id, turn, role, text, coalesce(last_value(case when role = 'user' then text end ignore nulls) over (partition by conv_id order by turn rows unbounded preceding), '') as said from conversations),
c as (select conv_id, list(struct_pack(role := role, content := case when role = 'assistant' then '<think>' || said || '</think>' || chr(10) || text else text end) order by turn) as m from r group by 1),
t as (select conv_id, list_filter(m, lambda x: x.role = 'assistant')[-1].content as x from c)
"""
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_WILSON = """case when n = 0 then 0.0 else greatest(0.0, (p + 1.96*1.96/(2*n)) / (1 + 1.96*1.96/n) - 1.96 * sqrt(p*(1-p)/n + 1.96*1.96/(4.0*n*n)) / (1 + 1.96*1.96/n)) end as low,
case when n = 0 then 0.0 else least(1.0, (p + 1.96*1.96/(2*n)) / (1 + 1.96*1.96/n) + 1.96 * sqrt(p*(1-p)/n + 1.96*1.96/(4.0*n*n)) / (1 + 1.96*1.96/n)) end as high"""


def _examples(spark: SparkSession, sf: str) -> DataFrame:
    return split.signed(split.deduplicated(X.order_decks(spark, sf)))


def _split(spark: SparkSession, sf: str) -> DataFrame:
    """The examples with their splits; they are written once, for they are read for who is held out and again for what is asked."""
    return split.assigned(written(_examples(spark, sf)))


# ---- splits ----


@query(_DECKS + "select split, count(*) as examples, count(distinct sig) as signatures from parts group by 1")
def split_counts(spark, sf):
    return split.counts(split.assigned(split.buckets(_examples(spark, sf))))


@query(_DECKS + """, tr as (select * from parts where split = 'train')
select (select count(*) from parts where split = 'test_a' and deck in (select deck from tr)) as exact_a,
 (select count(*) from parts where split = 'test_b' and deck in (select deck from tr)) as exact_b,
 (select count(distinct sig) from parts where split = 'test_b' and sig in (select sig from tr)) as coarse_b,
 (select count(*) from parts where split = 'test_b' and sig_fine in (select sig_fine from tr)) as fine_b,
 (select count(*) from (select unnest(string_split(sig, ',')) as k from parts where split = 'test_b' except select unnest(string_split(sig, ',')) from tr)) as kinds_lost,
 true as clean""")  # fmt: skip
def split_audit(spark, sf):
    return split.audit(_split(spark, sf))


@query(_DECKS + "select (select count(*) from decks) as pool, (select count(*) from uniq) as kept, (select count(*) from decks) - (select count(*) from uniq) as removed")
def dedupe_counts(spark, sf):
    decks = X.order_decks(spark, sf)
    pool = decks.groupBy("deck").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pool"), F.count(F.lit(1)).alias("kept"))
    return pool.withColumn("removed", F.col("pool") - F.col("kept"))


@query("select min(doc_id) as seq, text as deck from documents group by text")
def dedupe_documents(spark, sf):
    return split.deduplicated(X.table(spark, sf, "documents").select(F.col("doc_id").alias("seq"), F.col("text").alias("deck")))


@query(_DECKS + "select * from prot")
def protected_signatures(spark, sf):
    return split.protected(_examples(spark, sf))


@query(_DECKS + "select kind, count(*) as n_sigs, min(sig) as sig from kindsig group by 1")
def kind_spread(spark, sf):
    return split.kind_spread(_examples(spark, sf))


@query(_DECKS + "select sig, sig_hash from heldout")
def held_out_signatures(spark, sf):
    return split.held_out(_examples(spark, sf))


@query(_DECKS + "select split, min(n) as fewest, max(n) as most from (select split, sig, count(*) as n from parts group by 1, 2) group by 1")
def examples_per_signature(spark, sf):
    sizes = split.assigned(split.buckets(_examples(spark, sf))).groupBy("split", "sig").agg(F.sum("n").alias("n"))
    return sizes.groupBy("split").agg(F.min("n").alias("fewest"), F.max("n").alias("most"))


@query(_DECKS + "select split, count(*) as n from parts where len(list_filter(string_split(sig, ','), lambda k: starts_with(k, 'tiny_'))) > 0 group by 1")
def tail_bearing_examples(spark, sf):
    tails = [f"tiny_{k}" for k in ("economy", "large", "medium", "promo", "small", "standard")]
    return split.tail_bearing(_split(spark, sf), tails).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query(_DECKS + "select seq, sig, sig_fine, h, sha1(deck) as key from signed")
def signatures_and_buckets(spark, sf):
    return _examples(spark, sf).select("seq", "sig", "sig_fine", "h", F.sha1(F.col("deck").cast("binary")).alias("key"))


@query(_DECKS + """, f as (select parts.*, min(seq) over (partition by sig) as first, ('0x' || substr(sha1(sig), 1, 8))::bigint as sh from parts)
select split, dense_rank() over (partition by split order by case when split = 'test_b' then sh else first end, case when split = 'test_b' then sig end) as sig_rank, seq from f""")  # fmt: skip
def output_order(spark, sf):
    """The place of every row in its split's file, by the rank of its signature and seq."""
    return split.ordered(_split(spark, sf)).select("split", "sig_rank", "seq")


@query(_DECKS + """, f as (select parts.*, min(seq) over (partition by sig) as first, ('0x' || substr(sha1(sig), 1, 8))::bigint as sh from parts)
select split, row_number() over (partition by split order by case when split = 'test_b' then sh else first end, case when split = 'test_b' then sig end, seq) - 1 as line_no, seq, deck from f""")  # fmt: skip
def written_in_order(spark, sf):
    """The splits' files in output order, read again line by line."""
    path = shared_dir(spark)
    sinks.write_ordered(split.ordered(_split(spark, sf)), path, ["sig_rank", "seq"], columns=["seq", "deck"])
    out = None
    for name in ("train", "val", "test_a", "test_b"):
        if not exists(spark, f"{path}/split={name}"):
            continue
        part = records.physical_lines(spark, f"{path}/split={name}").select(F.lit(name).alias("split"), "line_no", F.from_json("value", "seq long, deck string").alias("r"))
        out = part if out is None else out.unionByName(part)
    return out.select("split", "line_no", "r.seq", "r.deck")


# ---- tail metrics ----


@query(_PAIRS + "select kind, n, part from parts")
def head_and_tail(spark, sf):
    return tail.partitioned(tail.document_frequency(X.gold_pred(spark, sf).select(F.col("gold").alias("kinds"))))


def _parts(pairs: DataFrame) -> DataFrame:
    return tail.partitioned(tail.document_frequency(pairs.select(F.col("gold").alias("kinds"))))


@query(_PAIRS + """select 1000 as "cut", (select count(distinct seq) from gold) as n_train, coalesce(string_agg(kind, ' ' order by kind) filter (where n < 1000), '') as tail,
 coalesce(string_agg(kind, ' ' order by kind) filter (where n >= 1000), '') as head, string_agg(kind || '=' || n, ' ' order by n desc, kind) as freq from parts""")  # fmt: skip
def registered_cut(spark, sf):
    """The document that fixes head and tail, with the frequencies from the most to the least."""
    pairs = X.gold_pred(spark, sf)
    n = X.table(spark, sf, "lineitem").select(F.countDistinct("l_orderkey").alias("n"))
    row = tail.registered(tail.document_frequency(pairs.select(F.col("gold").alias("kinds"))), F.lit(0)).drop("n_train").crossJoin(F.broadcast(n))  # two single rows
    freq = F.array_join(F.transform("freq", lambda x: F.concat_ws("=", x["kind"], x["n"].cast("string"))), " ")
    return row.select("cut", F.col("n").alias("n_train"), F.array_join("tail", " ").alias("tail"), F.array_join("head", " ").alias("head"), freq.alias("freq"))


@query(_PAIRS + "select kind, gold, pred, hit from hits")
def kind_hits(spark, sf):
    return tail.hits(X.gold_pred(spark, sf))


@query(_PAIRS + """select kind, part = 'tail' as is_tail, gold, pred, hit, hit / gold as recall, case when pred = 0 then 0.0 else hit / pred end as precision, gold < 30 as few
from hits join parts using (kind) where gold > 0""")  # fmt: skip
def tail_report(spark, sf):
    pairs = X.gold_pred(spark, sf)
    return tail.report(tail.hits(pairs), _parts(pairs))


@query(_PAIRS + "select row_number() over (order by part = 'tail' desc, gold desc, kind) as place, kind, gold from hits join parts using (kind) where gold > 0")
def tail_report_in_order(spark, sf):
    """The places of the report's rows: the tail first, then by gold."""
    pairs = X.gold_pred(spark, sf)
    rows = tail.report(tail.hits(pairs), _parts(pairs))
    return ordering.running(rows, [F.desc("is_tail"), F.desc("gold"), F.col("kind")], place="place").select("place", "kind", "gold")


@query(_PAIRS + f"select part, gold, hit, p as recall, {_WILSON} from (select part, sum(gold)::bigint as gold, sum(hit)::bigint as hit, sum(gold)::double as n, sum(hit) / sum(gold) as p from hits join parts using (kind) group by 1)")
def tail_recall(spark, sf):
    pairs = X.gold_pred(spark, sf)
    return tail.recall(tail.hits(pairs), _parts(pairs))


@query(_PAIRS + "select kind, pred from hits where gold = 0")
def hallucinated_kinds(spark, sf):
    return tail.hallucinated(tail.hits(X.gold_pred(spark, sf)))


# ---- chats ----


@query(_CHATS + "select conv_id, a[-1].content as last_assistant, u[1].content as first_user, a[1].content as first_assistant from t")
def chat_turns(spark, sf):
    return X.chats(spark, sf).select("conv_id", C.last_assistant("messages").alias("last_assistant"), C.first_user("messages").alias("first_user"), C.first_assistant("messages").alias("first_assistant"))


@query("select conv_id, " + _STRIP.format("text") + " as text from conversations where role = 'assistant' and " + _STRIP.format("text") + " <> ''")
def assistant_turns(spark, sf):
    return sampling.spoken(X.chats(spark, sf), "assistant")


@query("""with l as (select conv_id, max(turn) filter (where role = 'assistant') as ofs from conversations group by 1)
select l.conv_id, count(c.turn) as n, coalesce(string_agg(c.role, ',' order by c.turn), '') as roles from l left join conversations c on c.conv_id = l.conv_id and c.turn < l.ofs where ofs is not null group by 1""")  # fmt: skip
def chat_context(spark, sf):
    rows = X.chats(spark, sf).withColumn("context", C.context("messages")).where("context is not null")
    return rows.select("conv_id", F.size("context").cast("long").alias("n"), F.array_join(F.transform("context", lambda m: m["role"]), ",").alias("roles"))


@query(_CHATS + f"""select conv_id, array_to_string(list_transform(m, lambda x: case x.role when 'user' then '<|user|>' || chr(10) || x.content || chr(10)
 when 'assistant' then '<|assistant|>' || chr(10) || x.content || '{EOS}' else '' end), '') || '<|assistant|>' || chr(10) as text from c""")  # fmt: skip
def chat_template(spark, sf):
    return X.chats(spark, sf).select("conv_id", C.rendered("messages", EOS, prompt=True).alias("text"))


@query(f"""with l as (select conv_id, max(turn) filter (where role = 'assistant') as ofs from conversations group by 1)
select l.conv_id, coalesce(string_agg(case role when 'user' then '<|user|>' || chr(10) || text || chr(10) when 'assistant' then '<|assistant|>' || chr(10) || text || '{EOS}' else '' end, '' order by turn) filter (where turn < ofs), '')
 || '<|assistant|>' || chr(10) || max(text) filter (where turn = ofs) || '{EOS}' as text from l join conversations c using (conv_id) where ofs is not null group by 1""")  # fmt: skip
def training_text(spark, sf):
    return X.chats(spark, sf).where(C.last_assistant("messages").isNotNull()).select("conv_id", C.training_text("messages", EOS).alias("text"))


@query("""select item_id, case when item_id % 3 = 0 then text else text || chr(10) || chr(10) || lower(text) end as said, case when item_id % 2 = 0 then '' else lower(text) end as answer,
 '<|user|>' || chr(10) || text || chr(10) || '<|assistant|>' || chr(10) as prompt from benchmark""")  # fmt: skip
def instruction_records(spark, sf):
    b = X.table(spark, sf, "benchmark")
    made = C.from_instruction(F.col("text"), F.when(F.col("item_id") % 3 != 0, F.lower("text")), F.when(F.col("item_id") % 2 != 0, F.lower("text")))
    return b.withColumn("m", made).select("item_id", C.first_user("m").alias("said"), C.first_assistant("m").alias("answer"), C.prompt("text").alias("prompt"))


@query(_THINK + r"""select conv_id, """ + _STRIP.format(r"regexp_replace(x, '<think>.*?</think>\s*', '', 'gs')") + """ as without, """ + _STRIP.format("string_split(x, '</think>')[-1]") + """ as after_last,
 substr(x, strpos(x, '</think>') + 8) as after_first, strpos(x, '</think>') + 7 as at, """ + _STRIP.format("substr(x, strpos(x, '</think>') + 8)") + " as until from t where x is not null")  # fmt: skip
def deck_extraction(spark, sf):
    rows = X.chats(spark, sf, scratchpad=True).select("conv_id", C.last_assistant("messages").alias("x")).where("x is not null")
    return rows.select("conv_id", T.without_scratchpad("x").alias("without"), T.after_last_close("x").alias("after_last"), T.after_first_close("x").alias("after_first"), T.close_offset("x").cast("long").alias("at"), T.until_solve("x").alias("until"))


@query(f"select conv_id, turn, {_STRIP.format(chr(39) * 0 + 'text')} as text, text || chr(10) as corpus, ltrim(regexp_extract(url_, '[^/]+/*$'), '') as base from (select *, 'a/b/' || role || '/' as url_ from conversations)".replace("ltrim(regexp_extract(url_, '[^/]+/*$'), '')", "role"))
def post_processed(spark, sf):
    c = X.table(spark, sf, "conversations")
    return c.select("conv_id", "turn", T.without_eos(F.concat("text", F.lit(EOS)), EOS).alias("text"), F.concat("text", F.lit("\n")).alias("corpus"), T.basename(F.concat(F.lit("a/b/"), "role", F.lit("/"))).alias("base"))


@query("""select item_id, case when text = rev then length(text) else (select coalesce(min(i) - 1, least(length(text), length(rev))) from (select unnest(range(1, length(text) + 1)) as i) where substr(text, i, 1) <> substr(rev, i, 1)) end as at
from (select item_id, text, substr(text, 1, 10) || 'X' || substr(text, 11) as rev from benchmark)""")  # fmt: skip
def first_difference(spark, sf):
    b = X.table(spark, sf, "benchmark").withColumn("rev", F.concat(F.substring("text", 1, 10), F.lit("X"), F.expr("substring(text, 11)")))
    return b.select("item_id", T.first_difference("text", "rev").cast("long").alias("at"))


@query("""select item_id, '## Case ' || item_id || chr(10) || chr(10) || '**Prompt**' || chr(10) || chr(10) || text || chr(10) || chr(10) || '**Reference**' || chr(10) || chr(10) || lower(text) || chr(10) || chr(10)
 || '**A**' || chr(10) || chr(10) || lower(text) || chr(10) || chr(10) || '**B**' || chr(10) || chr(10) || text || chr(10) || chr(10) || '---' || chr(10) || chr(10) as block from benchmark""")  # fmt: skip
def case_blocks(spark, sf):
    return X.table(spark, sf, "benchmark").select("item_id", sinks.case_block(F.col("item_id"), F.col("text"), F.lower("text"), F.lower("text"), F.col("text")).alias("block"))


# ---- sampling ----


@query("""with d as (select doc_id, source in ('src1', 'src2') as is_tail from documents), h as (select * from d where not is_tail order by doc_id limit 70)
select * from (select * from d where is_tail union all select * from h) order by is_tail desc, doc_id limit 120""")  # fmt: skip
def stratified_sample(spark, sf):
    d = X.table(spark, sf, "documents").select("doc_id", F.col("source").isin("src1", "src2").alias("is_tail"))
    return sampling.stratified(d, "is_tail", 70, 120, "doc_id")


@query("select event_id, event_type from events order by event_id limit 50")
def head_rows(spark, sf):
    return sampling.head(X.table(spark, sf, "events").select("event_id", "event_type"), 50, "event_id")


@query("select * from (select 0 as dataset, doc_id as seq, text from documents order by doc_id limit 100) union all select 1, item_id, text from benchmark")
def mixed_datasets(spark, sf):
    d = X.table(spark, sf, "documents").select(F.col("doc_id").alias("seq"), "text", "lang")
    return sampling.mixed(d, X.table(spark, sf, "benchmark").select(F.col("item_id").alias("seq"), "text"), "text", 100)


@query("select event_id, event_type from events")
def shuffled_rows(spark, sf):
    return sampling.shuffled(X.table(spark, sf, "events").select("event_id", "event_type"), 3407, "event_id")


@query("select event_id from events where event_id not in (select event_id from events where event_id % 7 = 0)")
def resumed_rows(spark, sf):
    e = X.table(spark, sf, "events").select("event_id")
    return sampling.resumed(e, e.where("event_id % 7 = 0"), "event_id")


@query("select o_orderkey, o_orderstatus from orders where o_orderkey >= 100")
def resumed_offset(spark, sf):
    return sampling.resumed_at(X.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), 100, "o_orderkey")


@query("select d.doc_id as seq, d.text as prompt, b.text as reference, l.quality from documents d join benchmark b on d.doc_id = b.item_id join labels l on l.doc_id = d.doc_id")
def zipped_rows(spark, sf):
    d = X.table(spark, sf, "documents").select(F.col("doc_id").alias("seq"), F.col("text").alias("prompt"))
    b = X.table(spark, sf, "benchmark").select(F.col("item_id").alias("seq"), F.col("text").alias("reference"))
    return sampling.zipped(d, b, X.table(spark, sf, "labels").select(F.col("doc_id").alias("seq"), "quality"))


@query("""select user_id, event_id, row_number() over w as idx, sum((event_type <> 'error')::bigint) over w as so_far, sum((event_type <> 'error')::bigint) over w / row_number() over w as rate from events
window w as (partition by user_id order by ts, event_id rows unbounded preceding)""")  # fmt: skip
def running_rate(spark, sf):
    out = sampling.running(X.statuses(spark, sf), "ok", ["ts", "event_id"], ["user_id"])
    return out.select("user_id", "event_id", "idx", "so_far", "rate")


@query("""select user_id, event_id, idx, round(mean * (total - idx), 6) as eta from (select user_id, event_id, row_number() over w as idx, avg(value) over w as mean, count(*) over (partition by user_id) as total from events
window w as (partition by user_id order by ts, event_id rows unbounded preceding)) where idx % 5 = 0""")  # fmt: skip
def remaining_time(spark, sf):
    from pyspark.sql import Window

    out = sampling.running(X.statuses(spark, sf), "value", ["ts", "event_id"], ["user_id"])
    total = F.count(F.lit(1)).over(Window.partitionBy("user_id"))
    return out.withColumn("total", total).where("idx % 5 = 0").select("user_id", "event_id", "idx", F.round(F.col("rate") * (F.col("total") - F.col("idx")), 6).alias("eta"))


@query("""select event_id, row_number() over w as idx, sum((event_type <> 'error')::bigint) over w as so_far, sum((event_type <> 'error')::bigint) over w / row_number() over w as rate from events
window w as (order by ts, event_id rows unbounded preceding)""")  # fmt: skip
def running_rate_of_all(spark, sf):
    """The rate over one long log, without a group to cut it by."""
    return sampling.running(X.statuses(spark, sf), "ok", ["ts", "event_id"]).select("event_id", "idx", "so_far", "rate")


@query("""select event_id, idx, round(mean * (total - idx), 3) as eta from (select event_id, row_number() over w as idx, avg(event_id % 50 + 1) over w as mean, count(*) over () as total from events
window w as (order by ts, event_id rows unbounded preceding)) where idx % 25 = 0""")  # fmt: skip
def remaining_time_of_all(spark, sf):
    """The time left after every 25th row of one long log."""
    e = X.statuses(spark, sf).withColumn("seconds", F.col("event_id") % 50 + 1)
    return sampling.remaining(e, "seconds", ["ts", "event_id"]).select("event_id", "idx", F.round("eta", 3).alias("eta"))


# ---- metrics ----


@query("select round_even(m, 4) as eval_loss, round_even(exp(m), 4) as perplexity, n as tokens from (select sum(value / 100 * (event_id % 50 + 1)) / greatest(sum(event_id % 50 + 1), 1) as m, sum(event_id % 50 + 1)::bigint as n from events)")
def weighted_loss(spark, sf):
    e = X.statuses(spark, sf).select((F.col("value") / 100).alias("loss"), (F.col("event_id") % 50 + 1).alias("n_tokens"))
    return metrics.weighted_loss(e)


@query("select event_id % 10 as shard, count(*) as n, sum((event_type <> 'error')::bigint)::bigint as n_ok, round_even(sum((event_type <> 'error')::bigint) / count(*), 4) as rate from events group by 1")
def success_rates(spark, sf):
    return metrics.success_rate(X.statuses(spark, sf).withColumn("shard", F.col("event_id") % 10), "ok", ["shard"], 4)


@query("select doc_id, greatest(0.0, 1 - (case when toxic = 1 then 1.0::double else 0.0 end + case when quality = 0 then 0.4::double else 0.0 end)) as score, not (toxic = 1 or quality = 0) as adequate from labels")
def adequacy(spark, sf):
    return metrics.adequacy(X.table(spark, sf, "labels"), X.findings(spark, sf), "doc_id")


@query("select source, max_by(doc_id, (n_chars, doc_id)) as doc_id, max(n_chars) as n_chars from documents group by 1")
def best_of_source(spark, sf):
    return metrics.best_of(X.table(spark, sf, "documents"), "source", "doc_id", "n_chars")


_TOKEN = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"


@query(rf"""with d as (select * from documents order by doc_id limit 200), t as (select len(regexp_extract_all(string_agg(text, '' order by doc_id), '{_TOKEN}'))::bigint as tokens, count(*) as k from d), n as (select count(*) as n from documents)
select tokens, tokens / k as mean_tokens, n * (tokens / k) * 3 as total_tokens, n * (tokens / k) * 3 / 5000.0::double as seconds, 8 * 2048 * n / 3600.0::double as tokens_per_second from t, n""")  # fmt: skip
def token_extrapolation(spark, sf):
    """Tokens of the first 200 texts put together, extrapolated to all: the sample is the feature."""
    d = X.table(spark, sf, "documents")
    some = metrics.joined_tokens(d, 200, f"({_TOKEN})", "doc_id")
    both = some.crossJoin(F.broadcast(d.agg(F.count(F.lit(1)).alias("n"))))  # two single rows
    made = metrics.token_budget(F.col("n"), F.col("tokens"), F.col("counted"), 3, F.lit(5000.0))
    speed = metrics.throughput(F.lit(8), F.lit(2048), F.col("n"), F.lit(3600.0))
    return both.select("tokens", *[c.alias(k) for k, c in made.items()], speed.alias("tokens_per_second"))


@query("select count(*) as n, sum((lower(text) = text)::bigint)::bigint as same, sum((lower(text) = text)::bigint) / count(*) as rate, sum(n_chars) / greatest(sum(doc_id % 7), 1e-9) as speedup from documents")
def output_agreement(spark, sf):
    d = X.table(spark, sf, "documents").withColumn("low", F.lower("text")).withColumn("fast", F.col("doc_id") % 7)
    return metrics.agreement(d, "text", "low", "n_chars", "fast")


_TENSORS = """with a as (select vec_id, embedding as x from embeddings where vec_id % 50 <> 7), b as (select vec_id, list_transform(embedding, lambda v: case when vec_id % 4 = 0 then v * 1.5 else v end) as y from embeddings),
c as (select vec_id, x is not null and y is not null as in_both, list_max(list_transform(range(1, 65), lambda i: abs(x[i]::double - y[i]::double))) as d from a full join b using (vec_id))
"""


def _changes(spark: SparkSession, sf: str) -> DataFrame:
    e = X.table(spark, sf, "embeddings")
    name = F.concat(F.lit("t"), F.col("vec_id").cast("string")).alias("name")
    a = e.where("vec_id % 50 != 7").select(name, F.col("embedding").alias("values"))
    b = e.select(name, F.transform("embedding", lambda v: F.when(F.col("vec_id") % 4 == 0, v.cast("double") * 1.5).otherwise(v.cast("double"))).alias("values"))
    return metrics.tensor_changes(a, b)


@query(_TENSORS + "select 't' || vec_id as name, in_both, round(case when in_both then d end, 5) as max_diff from c")
def tensor_changes(spark, sf):
    return _changes(spark, sf).withColumn("max_diff", F.round("max_diff", 5))


@query(_TENSORS + "select count(*) as n, bool_and(in_both) as same_names, sum((in_both and d = 0)::bigint)::bigint as unchanged, round(max(case when in_both then d end), 5) as max_diff, bool_and(in_both) and sum((in_both and d = 0)::bigint) / count(*) < 0.5 and max(case when in_both then d end) > 1e-6 as moved from c")
def tensor_verdict(spark, sf):
    return metrics.tensor_verdict(_changes(spark, sf)).withColumn("max_diff", F.round("max_diff", 5))


@query("""with c as (select max(list_max(list_transform(range(1, 65), lambda i: abs(embedding[i]::double * 0.5)))) as d, count(*) as n, sum((vec_id % 3 = 0)::bigint) as same,
 max(case when vec_id % 3 <> 0 then list_max(list_transform(range(1, 65), lambda i: abs(embedding[i]::double * 0.5))) end) as m from embeddings)
select n, true as same_names, same::bigint as unchanged, round(m, 5) as max_diff, same / n < 0.5 and m > 1e-6 as moved from c""")  # fmt: skip
def tensor_verdict_moved(spark, sf):
    """The verdict on a model that training has moved: two tensors of three have changed."""
    e = X.table(spark, sf, "embeddings").withColumn("name", F.col("vec_id").cast("string"))
    values = F.transform("embedding", lambda v: v.cast("double"))
    changed = F.when(F.col("vec_id") % 3 == 0, values).otherwise(F.transform(values, lambda v: v * 1.5))
    return metrics.tensor_verdict(metrics.tensor_changes(e.select("name", values.alias("values")), e.select("name", changed.alias("values")))).withColumn("max_diff", F.round("max_diff", 5))


@query(_TENSORS + "select 't' || vec_id as name, round(d, 5) as max_diff from c where in_both order by d desc, 't' || vec_id limit 5")
def most_changed_tensors(spark, sf):
    return _changes(spark, sf).where("in_both").orderBy(F.desc("max_diff"), "name").limit(5).select("name", F.round("max_diff", 5).alias("max_diff"))


@query("select sum(len(embedding))::bigint as parameters from embeddings")
def parameter_count(spark, sf):
    return metrics.parameters(X.table(spark, sf, "embeddings").select(F.col("embedding").alias("values")))


# ---- runs ----


@query("""with l as (select user_id, event_id, case when event_type = 'click' then 'step frac in_deck=' || (event_id % 90 + 10) / 100.0 end as line from events),
m as (select user_id, arg_min(line, event_id) as line from l where line is not null group by 1)
select user_id, regexp_extract(line, 'in_deck=([0-9.]+)', 1)::double as metric, regexp_extract(line, 'in_deck=([0-9.]+)', 1)::double > 0.2 and regexp_extract(line, 'in_deck=([0-9.]+)', 1)::double < 0.75 as valid from m""")  # fmt: skip
def run_metric(spark, sf):
    text = F.concat(F.lit("step frac in_deck="), ((F.col("event_id") % 90 + 10) / 100.0).cast("string"))
    log = X.statuses(spark, sf).select("user_id", F.col("event_id").alias("seq"), F.when(F.col("event_type") == "click", text).alias("value"))
    return runs.first_metric(log.where("value is not null"), by=["user_id"]).withColumn("valid", runs.valid(F.col("metric")))


@query("select o_custkey % 5 as run, max(o_orderkey * 500) as step, true as complete from orders where o_custkey % 5 <> 3 group by 1 union all select 3, max(o_orderkey * 500), false from orders where o_custkey % 5 = 3")
def checkpoints(spark, sf):
    o = X.table(spark, sf, "orders")
    runs_ = o.select((F.col("o_custkey") % 5).alias("run"), F.concat(F.lit("out/checkpoint-"), (F.col("o_orderkey") * 500).cast("string")).alias("path"))
    keys = runs_.select("run").distinct()
    files = keys.select("run", F.explode(F.when(F.col("run") == 3, F.array(F.lit("out/config.json"))).otherwise(F.array(F.lit("out/config.json"), F.lit("out/model.safetensors")))).alias("path"))
    return runs.latest_checkpoint(runs_, by=["run"]).join(runs.complete(runs_.unionByName(files)), "run")


@query("select s_suppkey, not ((s_suppkey % 3 = 0) and s_suppkey % 2 = 0) and s_suppkey % 7 <> 0 as valid from supplier")
def export_validity(spark, sf):
    k = F.col("s_suppkey")
    return X.table(spark, sf, "supplier").select("s_suppkey", runs.export_valid(F.array(F.lit(8), k % 3), k % 2, k % 7 != 0).alias("valid"))


@query("select event_type as status, count(*) as n from events group by 1")
def status_counts(spark, sf):
    return runs.status_counts(X.statuses(spark, sf).withColumnRenamed("event_type", "status"))


@query("""select c_custkey, case when c_custkey % 3 = 0 then c_name else n_name end as name, case when c_custkey % 5 = 0 then null when c_custkey % 3 = 1 then c_mktsegment else 'r' || n_regionkey end as segment,
 'k' || c_nationkey as nation, case when c_custkey % 3 <> 2 then c_mktsegment end as own from customer join nation on c_nationkey = n_nationkey""")  # fmt: skip
def merged_maps(spark, sf):
    """Customers' settings filled from their nation's, then some forced, removed or left alone."""
    c, n = X.table(spark, sf, "customer"), X.table(spark, sf, "nation")
    k, row = F.col("c_custkey"), c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    entry = lambda when, key, value: F.when(when, F.array(F.struct(F.lit(key).alias("k"), value.cast("string").alias("v")))).otherwise(F.array().cast("array<struct<k:string,v:string>>"))
    own = F.map_from_entries(F.concat(entry(k % 3 == 0, "name", F.col("c_name")), entry(k % 3 == 1, "segment", F.col("c_mktsegment")), entry(k % 3 != 2, "own", F.col("c_mktsegment"))))
    reference = F.create_map(F.lit("name"), F.col("n_name"), F.lit("segment"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")))
    forced = F.create_map(F.lit("nation"), F.concat(F.lit("k"), F.col("c_nationkey").cast("string")))
    made = runs.overridden(runs.filled(own, reference), forced)
    made = F.when(k % 5 == 0, F.map_filter(made, lambda key, value: key != "segment")).otherwise(made)
    return row.withColumn("m", made).select("c_custkey", *[F.try_element_at("m", F.lit(x)).alias(x) for x in ("name", "segment", "nation", "own")])


@query("select n_nationkey, 'own' as kept, case when n_nationkey % 2 = 0 then 'own' else 'ref' end as filled, 'forced' as forced, case when n_name like '%A%' then 0 else 700 end as head from nation")
def config_merge(spark, sf):
    n = X.table(spark, sf, "nation")
    own = F.when(F.col("n_nationkey") % 2 == 0, F.create_map(F.lit("a"), F.lit("own"), F.lit("b"), F.lit("own"))).otherwise(F.create_map(F.lit("a"), F.lit("own")))
    ref = F.create_map(F.lit("a"), F.lit("ref"), F.lit("b"), F.lit("ref"))
    made = runs.overridden(runs.filled(own, ref), F.create_map(F.lit("c"), F.lit("forced")))
    arm = F.when(F.col("n_name").contains("A"), "run_tsd").otherwise("base")
    return n.withColumn("m", made).select("n_nationkey", F.col("m")["a"].alias("kept"), F.col("m")["b"].alias("filled"), F.col("m")["c"].alias("forced"), runs.head_size(arm).alias("head"))


# ---- trees ----

#: Ids that the taxonomy gives to the kinds of these decks (kind, kind id, family id); the others share 62 and 7.
_IDS = (("model", 31, 4), ("beam", 5, 5), ("weld", 61, 3), ("fix", 20, 2), ("load", 28, 1), ("solve", 49, 0), ("//", 0, 6))
_LN = (
    "with "
    + _LINES.format(mono="false")
    + """, worded as (select *, case when l_linenumber % 5 = 0 then '//' else case kind when 'economy' then 'model' when 'large' then 'beam' when 'medium' then 'weld' when 'promo' then 'fix'
   when 'small' then 'load' when 'standard' then 'solve' else kind end end || ' ' || nm || ' ' || q || case when l_linenumber % 3 = 0 then chr(10) else '' end as line from lines),
decks as (select l_orderkey as ex, string_agg(line, chr(10) order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, kind, line) as deck from worded group by 1),
ln as (select ex, generate_subscripts(ls, 1) - 1 as line_no, unnest(ls) as txt, len(ls) as n from (select ex, string_split(deck, chr(10)) as ls from decks)),
p0 as (select *, length(txt) + (line_no < n - 1)::int as w, txt <> '' as filled from ln where not (line_no = n - 1 and txt = '')),
pos as (select *, coalesce(sum(w) over (partition by ex order by line_no rows between unbounded preceding and 1 preceding), 0)::int as ofs,
  sum(filled::int) over (partition by ex order by line_no rows unbounded preceding)::int as stmt,
  sum((filled and before)::int) over (partition by ex order by line_no rows unbounded preceding)::int as block,
  split_part(txt, ' ', 1) as k, split_part(txt, ' ', 2) as nm from (select *, coalesce(lag(not filled) over (partition by ex order by line_no), true) as before from p0)),
ids as (select ex, ofs, w, stmt, block, txt, length(k) as a, length(nm) as b, coalesce({kind}, 62) as kind_id, coalesce({family}, 7) as family_id from pos where filled),
seg as (select ex, ofs as s, ofs + a as e, kind_id, family_id, stmt, block, 0 as slot from ids union all select ex, ofs + a, ofs + a + 1 + b, kind_id, family_id, stmt, block, 1 from ids
 union all select ex, ofs + a + 1 + b, ofs + w, kind_id, family_id, stmt, block, 2 from ids)
""".format(**{name: "case k " + " ".join(f"when '{r[0]}' then {r[col]}" for r in _IDS) + " end" for name, col in (("kind", 1), ("family", 2))})
)


@query(_LN + 'select ex, s as start, e as "end", kind_id, stmt, slot from seg where s < e')
def typed_tree(spark, sf):
    p = F.col("path")
    return tree.typed_segments(X.known_decks(spark, sf)).select("ex", "start", "end", p[0].alias("kind_id"), p[1].alias("stmt"), p[2].alias("slot"))


@query(_LN + 'select ex, s as start, e as "end", family_id, kind_id, stmt, slot from seg where s < e')
def typed_tree_with_family(spark, sf):
    p = F.col("path")
    return tree.segments("ast-fam", X.known_decks(spark, sf)).select("ex", "start", "end", p[0].alias("family_id"), p[1].alias("kind_id"), p[2].alias("stmt"), p[3].alias("slot"))


@query(_LN + 'select ex, ofs as start, ofs + w as "end", block, stmt as line from ids')
def fallback_tree(spark, sf):
    p = F.col("path")
    return tree.segments("fallback", X.known_decks(spark, sf)).select("ex", "start", "end", p[0].alias("block"), p[1].alias("line"))


@query("""with ln as (select doc_id, generate_subscripts(ls, 1) - 1 as line_no, unnest(ls) as raw, len(ls) as n from (select doc_id, string_split(text, chr(10)) as ls from documents)),
p as (select *, length(raw) + (line_no < n - 1)::int as w, trim(raw, ' ' || chr(9)) = '' as blank from ln where not (line_no = n - 1 and raw = '')),
q as (select *, coalesce(sum(w) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding), 0)::int as ofs, not blank and coalesce(lag(blank) over (partition by doc_id order by line_no), true) as opens from p)
select doc_id as ex, line_no, ofs, case when not blank then sum((not blank)::int) over (partition by doc_id order by line_no rows unbounded preceding) end::int as stmt,
 case when not blank then sum(opens::int) over (partition by doc_id order by line_no rows unbounded preceding) end::int as block from q""")  # fmt: skip
def line_ordinals(spark, sf):
    return tree.deck_lines(X.table(spark, sf, "documents"), "doc_id", "text").select("ex", F.col("line_no").cast("long").alias("line_no"), F.col("at").alias("ofs"), "stmt", "block")


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    return tree.deck_runs(X.known_decks(spark, sf))


_TOK = _LN + r""", tk as (select ex, ofs, txt, unnest(range(1, length(txt) + 1)) as i from ids),
st as (select ex, ofs + i - 1 as local from tk where substr(txt, i, 1) <> ' ' and (i = 1 or not regexp_matches(substr(txt, i, 1), '[\p{L}\p{N}_]') or not regexp_matches(substr(txt, i - 1, 1), '[\p{L}\p{N}_]'))),
tok as (select ex, local, row_number() over (partition by ex order by local) + 2 as t from st),
pt as (select tok.ex, t, kind_id as p0, seg.stmt as p1, slot as p2, block as b0, true as in_deck from tok join seg on tok.ex = seg.ex and local >= s and local < e
 union all select ex, unnest([0, 1, 2]), -1, -1, -1, -1, false from decks),
pr as (select a.ex, a.t as i, b.t as j, a.in_deck and b.in_deck as met,
 3 - case when a.in_deck and b.in_deck then (a.p0 = b.p0)::int + (a.p0 = b.p0 and a.p1 = b.p1)::int + (a.p0 = b.p0 and a.p1 = b.p1 and a.p2 = b.p2)::int else 0 end as d from pt a join pt b on a.ex = b.ex)
"""


@query(_TOK + "select ex, t, p0 as kind_id, p1 as stmt, p2 as slot, in_deck from pt")
def token_paths(spark, sf):
    p = F.col("path")
    return tree.tokens_of(_runs(spark, sf)).select("ex", F.col("t").cast("long").alias("t"), p[0].alias("kind_id"), p[1].alias("stmt"), p[2].alias("slot"), "in_deck")


@query()
def pair_bias(spark, sf):
    """All pairs of tokens: too many for the SQL check, which has their sums (bias_of_decks); a test has them by brute force."""
    b = tree.expanded(tree.bias_blocks(_runs(spark, sf), "linear", 0.5, 3, levels=3))
    return b.select("ex", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "d", "bias")


@query(_TOK + ", mx as (select ex, max(t) as i from pt group by 1) select pr.ex, pr.i, j, d, case when pr.i = j or not met then 0.0 else -0.5 * (1 - pow(2.0, -d)) end as bias from pr join mx on pr.ex = mx.ex and pr.i = mx.i")
def newest_row_bias(spark, sf):
    b = tree.biased(tree.newest_row(_runs(spark, sf), 3), "padic", 0.5)
    return b.select("ex", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "d", "bias")


@query(_TOK + """, mx as (select ex, max(t) as i from pt group by 1), nw as (select pt.* from pt join mx on pt.ex = mx.ex and pt.t = mx.i)
select a.ex, a.t as i, b.t as j, 2 - case when a.in_deck and b.in_deck then (a.b0 = b.b0)::int + (a.b0 = b.b0 and a.p1 = b.p1)::int else 0 end as d,
 case when a.t = b.t or not (a.in_deck and b.in_deck) then 0.0 else -2.0::double * (2 - (a.b0 = b.b0)::int - (a.b0 = b.b0 and a.p1 = b.p1)::int) / 2 end as bias from nw a join pt b on a.ex = b.ex""")  # fmt: skip
def whole_bias(spark, sf):
    """From texts to biases in one call, by the tree of blocks; the newest token's row of each."""
    b = tree.bias(X.known_decks(spark, sf), "linear", 2.0, newest_only=True, normalise=True)
    return b.select("ex", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "d", "bias")


@query(_TOK + "select d, count(*) as pairs, sum((j > i)::bigint)::bigint as hidden from pr group by 1")
def distance_counts(spark, sf):
    return tree.distance_counts(_runs(spark, sf))


@query(_TOK + "select ex, count(*) as pairs, count(*) filter (where met and d > 0) as biased, round(sum(case when met and i <> j then -0.5 * d / 3 else 0 end), 6) as total from pr where i <= j group by 1")
def bias_of_decks(spark, sf):
    """The bias by pairs of runs: how many pairs a deck has, how many of them have a bias, and its sum."""
    blocks = tree.bias_blocks(_runs(spark, sf), "linear", 0.5, 3, levels=3)
    return tree.bias_sums(blocks).select("ex", "pairs", "biased", F.round("total", 6).alias("total"))


@query(_TOK + """, r0 as (select *, coalesce(p0 = lag(p0) over w and p1 = lag(p1) over w and p2 = lag(p2) over w and in_deck = lag(in_deck) over w, false) as same from pt window w as (partition by ex order by t)),
r1 as (select *, sum((not same)::int) over (partition by ex order by t rows unbounded preceding) as run from r0)
select ex, min(t) as t0, max(t) as t1, any_value(p0) as kind_id, any_value(p1) as stmt, any_value(p2) as slot, any_value(in_deck) as in_deck from r1 group by ex, run""")  # fmt: skip
def token_runs(spark, sf):
    """Neighbouring tokens of one path as one row."""
    p = F.col("path")
    return _runs(spark, sf).select("ex", F.col("t0").cast("long").alias("t0"), F.col("t1").cast("long").alias("t1"), p[0].alias("kind_id"), p[1].alias("stmt"), p[2].alias("slot"), "in_deck")


@query(_TOK + """, per as (select ex, count(distinct p0) filter (where in_deck) as top, count(distinct (p0, p1)) filter (where in_deck) as second, count(*) as n, avg(in_deck::int) as share from pt group by 1 having sum(in_deck::int) >= 2),
ap as (select ex, sum((d > 0)::int) as apart from pr where met group by 1),
g as (select avg(top) as mean_top, min(top) as min_top, max(top) as max_top, avg(second) as mean_second, round(avg(apart / (n * n)), 9) as mean_biased,
 (select count(distinct d) from pr where met) as n_distances, (select round(avg(share), 9) from (select avg(in_deck::int) as share from pt group by ex)) as mean_in_deck from per join ap using (ex))
select *, n_distances > 1 and mean_top > 1.5 and mean_biased > 0.05 as passes from g""")  # fmt: skip
def tree_structure(spark, sf):
    made = tree.structure_gate(tree.structure(_runs(spark, sf)))
    return made.withColumns({c: F.round(c, 9) for c in ("mean_biased", "mean_in_deck")})


@query(_TOK + """, nx as (select ex, t as i, lead(t) over w as j, in_deck and lead(in_deck) over w as met, p0 = lead(p0) over w as a, p1 = lead(p1) over w as b, p2 = lead(p2) over w as c from pt window w as (partition by ex order by t))
select ex, i, j, case when met then a::int + (a and b)::int + (a and b and c)::int else 0 end as shared from nx where j is not null""")  # fmt: skip
def neighbour_prefixes(spark, sf):
    return tree.prefix_lengths(_runs(spark, sf), 3).select("ex", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "shared")


@query(_TOK + "select round(avg(share), 9) as in_deck from (select avg(in_deck::int) as share from pt group by ex)")
def deck_coverage(spark, sf):
    return metrics.coverage(_runs(spark, sf)).select(F.round("in_deck", 9).alias("in_deck"))


@query(_LN + """, ls as (select ex, string_split(deck, chr(10)) as l from decks), cut as (select ex, l, list_position(list_transform(l, lambda x: starts_with(trim(x), 'solve ')), true) as p from ls)
select ex, """ + _STRIP.format("array_to_string(case when p > 0 then l[1:p] else l end, chr(10))") + " as until from cut")  # fmt: skip
def decks_until_solve(spark, sf):
    """Decks behind a scratchpad, cut after the first line that begins with the closing statement, or whole without one."""
    said = F.concat(F.lit("<think>solve "), F.col("ex").cast("string"), F.lit("</think>\n\n"), "deck", F.lit("\n"))
    return X.known_decks(spark, sf).select("ex", T.until_solve(said).alias("until"))


# ---- features ----

#: Fixed value: where configurations cut (max_seq_length).
MAX_LEN = 2048

_WORDS = """with w as (select doc_id, string_split(coalesce(text, ''), ' ') as ws from documents), f as (select doc_id, doc_id // 8 as batch, list_transform(ws, lambda w: length(w)::bigint) as ids from w),
t as (select doc_id, unnest(range(1, len(ids) + 1)) as i, unnest(ids) as n from f),
g as (select *, coalesce(sum(n + 1) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as start from t)
"""


def _features(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, batch, ids, starts) of whole texts, a batch for each eight ids."""
    ids, starts = features.word_features(F.col("text"))
    return X.table(spark, sf, "documents").select("doc_id", F.floor(F.col("doc_id") / 8).alias("batch"), ids.alias("ids"), starts.alias("starts"))


@query(_WORDS + "select doc_id, string_agg(case when start >= 60 then n else -100 end, ' ' order by i) as labels from g group by 1")
def label_mask(spark, sf):
    labels = features.label_mask(F.col("ids"), F.col("starts"), F.lit(60))
    rows = features.with_hook(_features(spark, sf), lambda df: df.withColumn("labels", labels))
    return rows.select("doc_id", F.array_join(F.transform("labels", lambda x: x.cast("string")), " ").alias("labels"))


@query(_WORDS + ", b as (select *, max(len(ids)) over (partition by batch) as l from f) select doc_id, array_to_string(list_concat(ids, list_transform(range(l - len(ids)), lambda i: 0)), ' ') as ids, len(ids) as ones, l - len(ids) as zeros from b")
def padded_batch(spark, sf):
    out = features.padded(_features(spark, sf).select("doc_id", "batch", "ids"), "batch")
    ones = F.size(F.filter("mask", lambda x: x == 1)).cast("long")
    return out.select("doc_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"), ones.alias("ones"), (F.size("mask") - ones).cast("long").alias("zeros"))


@query(_WORDS + "select doc_id, array_to_string(ids[1:2048], ' ') as ids from f")
def truncated_ids(spark, sf):
    ids = features.truncated(F.col("ids"), MAX_LEN)
    return _features(spark, sf).select("doc_id", F.array_join(F.transform(ids, lambda x: x.cast("string")), " ").alias("ids"))


@query("""with w as (select unnest(regexp_extract_all(text, '([\\p{L}]+)')) as word from documents), c as (select hex(encode(word)) as h, count(*) as n from w group by 1),
p as (select n, h, unnest(range(0, length(h) // 2 - 1)) as i from c) select substr(h, 2 * i + 1, 2) as a, substr(h, 2 * i + 3, 2) as b, sum(n)::bigint as n from p group by 1, 2""")  # fmt: skip
def byte_pairs(spark, sf):
    """How often two bytes stand side by side in the words of all texts."""
    return pairs.pair_counts(pairs.word_counts(X.table(spark, sf, "documents"), r"([\p{L}]+)"))


# ---- sources and sinks: written, then read again ----


@query(_CHATS + "select coalesce(u[1].content, '') as prompt, coalesce(a[1].content, '') as reference from t")
def written_chats(spark, sf):
    path = shared_dir(spark)
    sinks.append_pairs(X.chats(spark, sf).select("messages", F.lit("kept").alias("extra")), path)
    return records.prompts(records.read_records(spark, path))


@query("select row_number() over (order by c_custkey) - 1 as line_no, c_name as value from customer")
def numbered_lines(spark, sf):
    path = shared_dir(spark)
    sinks.write_corpus(X.table(spark, sf, "customer").orderBy("c_custkey"), path, "c_name")
    return records.physical_lines(spark, path).select("line_no", "value")


@query("select 0 as file_no, n_nationkey as line_no, n_name as prompt, lower(n_name) as reference from nation union all select 1, r_regionkey, r_name, lower(r_name) from region")
def pooled_records(spark, sf):
    paths = []
    for name in ("n_nation", "r_region"):
        paths.append(shared_dir(spark))
        rows = X.table(spark, sf, name[2:]).orderBy(f"{name}key").select(F.col(f"{name[:2]}name").alias("instruction"), F.lower(f"{name[:2]}name").alias("output"))
        rows.coalesce(1).write.json(paths[-1])
    return records.prompts(records.read_records(spark, *paths, ordered=True))


@query("select 0 as file_no, r_regionkey as line_no, r_name as prompt from region where r_regionkey < 3")
def first_records(spark, sf):
    path = shared_dir(spark)
    X.table(spark, sf, "region").orderBy("r_regionkey").select(F.col("r_name").alias("instruction")).coalesce(1).write.json(path)
    return records.prompts(records.read_records(spark, path, limit_lines=3)).select("file_no", "line_no", "prompt")


@query(_DECKS + "select seq, split, deck from parts")
def written_splits(spark, sf):
    path = shared_dir(spark)
    sinks.write_splits(_split(spark, sf).select("seq", "split", "deck"), path)
    return spark.read.schema("seq long, deck string, split string").json(path).select("seq", "split", "deck")


@query("select item_id, text as gold, case when item_id % 3 = 0 then null else lower(text) end as pred, item_id % 2 = 0 as cola from benchmark")
def written_reports(spark, sf):
    path = shared_dir(spark)
    pred = F.when(F.col("item_id") % 3 != 0, F.lower("text"))
    sinks.append_pairs(X.table(spark, sf, "benchmark").select("item_id", F.col("text").alias("gold"), pred.alias("pred"), (F.col("item_id") % 2 == 0).alias("cola")), path)
    back = spark.read.schema("item_id long, gold string").json(path)
    return records.read_reports(spark, path).drop("file").join(back, "gold").select("item_id", "gold", "pred", "cola")


@query("""select item_id, 'q' || item_id as prompt, text as deck, item_id % 3 <> 0 and item_id % 5 <> 0 as ok,
 case when item_id % 3 = 0 then 'bad' when item_id % 5 = 0 then 'ValueError: odd' end as error from benchmark""")  # fmt: skip
def written_dump(spark, sf):
    """Decks validated from outside (a failure is a row), dumped and read again."""

    def check(deck: str) -> dict:
        k = int(deck.split(" ", 1)[0])
        if k % 3 and k % 5 == 0:
            raise ValueError("odd")
        return {"error": "bad"} if k % 3 == 0 else {"n": k}

    b, path = X.table(spark, sf, "benchmark"), shared_dir(spark)
    checked = validate.validated(b.select("item_id", F.concat_ws(" ", F.col("item_id").cast("string"), "text").alias("said")), check, "item_id", "said")
    sinks.write_dump(checked.join(b, "item_id").withColumns({"prompt": F.concat(F.lit("q"), F.col("item_id").cast("string")), "deck": F.col("text")}), path)
    back = spark.read.schema("prompt string, deck string, ok boolean, error string").json(path)
    return back.select(F.substring("prompt", 2, 20).cast("long").alias("item_id"), "prompt", "deck", "ok", "error")


# ---- strict reading, splits, counts, documents and configurations: written, then read again ----


def _lines_of_files(spark: SparkSession, sf: str, said: str) -> str:
    """A folder of JSONL lines, one a benchmark item in order of the items; some are broken or blank."""
    path = shared_dir(spark)
    b = X.table(spark, sf, "benchmark").withColumn("line", F.expr(said))
    sinks.write_corpus(b.repartitionByRange("item_id").sortWithinPartitions("item_id"), path, "line")
    return path


_BROKEN = """case when item_id % 7 = 3 then '{"instruction": ' when item_id % 11 = 5 then '  ' when item_id % 13 = 6 then '[1]' else concat('{"instruction": "i', item_id, '", "output": "', length(text), '"}') end"""
_NUMBERED = "with b as (select item_id, text, row_number() over (order by item_id) - 1 as line_no from benchmark) "


@query(_NUMBERED + """select line_no, case when item_id % 7 = 3 then '{"instruction": ' when item_id % 11 = 5 then '  ' else '[1]' end as value,
 case when item_id % 7 <> 3 and item_id % 11 = 5 then 'blank line' else 'not an object of the schema' end as why from b where item_id % 7 = 3 or item_id % 11 = 5 or item_id % 13 = 6""")  # fmt: skip
def broken_lines(spark, sf):
    """The places of the lines that a strict scan refuses."""
    _, broken = records.scan_strictly(spark, _lines_of_files(spark, sf, _BROKEN))
    return broken.select("line_no", "value", "why")


@query(_NUMBERED + "select line_no, 'i' || item_id as instruction, length(text)::varchar as output from b where not (item_id % 7 = 3 or item_id % 11 = 5 or item_id % 13 = 6)")
def strict_lines(spark, sf):
    """The lines that a strict scan takes, with their places among all."""
    good, _ = records.scan_strictly(spark, _lines_of_files(spark, sf, _BROKEN))
    return good.select("line_no", "instruction", "output")


@query(_NUMBERED + "select line_no, 'i' || item_id as instruction from b")
def strict_records(spark, sf):
    """A strict reading of files without a broken line."""
    path = _lines_of_files(spark, sf, "concat('{\"instruction\": \"i', item_id, '\"}')")
    return records.read_strictly(spark, path).select("line_no", "instruction")


@query("select 'train' as split, conv_id, count(*)::bigint as n from conversations where conv_id % 5 <> 0 group by 2 union all select 'validation', conv_id, count(*) from conversations where conv_id % 5 = 0 group by 2")
def loaded_splits(spark, sf):
    """Two files of chats, loaded as the splits of one dataset."""
    train, validation = shared_dir(spark), shared_dir(spark)
    chats = X.chats(spark, sf).select("conv_id", "messages", F.col("conv_id").cast("string").alias("instruction"))
    sinks.append_pairs(chats.where("conv_id % 5 != 0").drop("conv_id"), train)
    sinks.append_pairs(chats.where("conv_id % 5 = 0").drop("conv_id"), validation)
    loaded = records.load_splits(spark, train, validation)
    return loaded.select("split", F.col("instruction").cast("long").alias("conv_id"), F.size("messages").cast("long").alias("n"))


@query("select conv_id, count(*)::bigint as n from conversations where conv_id % 5 <> 0 group by 1")
def loaded_train_split(spark, sf):
    """A dataset of a single file has only the train split."""
    train = shared_dir(spark)
    chats = X.chats(spark, sf).select(F.col("conv_id").cast("string").alias("instruction"), "messages")
    sinks.append_pairs(chats.where("conv_id % 5 != 0"), train)
    return records.load_splits(spark, train).where("split = 'train'").select(F.col("instruction").cast("long").alias("conv_id"), F.size("messages").cast("long").alias("n"))


@query("select 'customer' as name, count(*) as lines from customer union all select 'supplier', count(*) from supplier")
def counted_lines(spark, sf):
    """Lines of two written corpora, also what a resumed run skips."""
    out = None
    for name, column in (("customer", "c_name"), ("supplier", "s_name")):
        path = shared_dir(spark)
        sinks.write_corpus(X.table(spark, sf, name), path, column)
        part = records.line_counts(spark, path).select(F.lit(name).alias("name"), "lines")
        out = part if out is None else out.unionByName(part)
    return out


@query(_PAIRS + "select 1000 as \"cut\", kind, n, part from parts")
def registered_document(spark, sf):
    """The document that fixes head and tail, written once in the shared folder, refused a second time, and read again."""
    pairs = X.gold_pred(spark, sf)
    row = tail.registered(tail.document_frequency(pairs.select(F.col("gold").alias("kinds"))), F.lit(0))
    path = f"{shared_dir(spark)}/registered.json"
    sinks.write_document(row, path, once=True)
    try:
        sinks.write_document(row, path, once=True)
    except FileExistsError:
        read = records.read_json_document(spark, path)
    entry = F.explode("freq").alias("f")
    part = F.when(F.array_contains("tail", F.col("f.kind")), "tail").when(F.array_contains("head", F.col("f.kind")), "head")
    return read.select("cut", "tail", "head", entry).select(F.col("cut").cast("int").alias("cut"), F.col("f.kind").alias("kind"), F.col("f.n").cast("long").alias("n"), part.alias("part"))


@query(_DECKS + "select split, count(*) as examples, count(distinct sig) as signatures from parts group by 1")
def written_manifest(spark, sf):
    """The split's counts as a document of one row, written and read again."""
    counts = split.counts(split.assigned(split.buckets(_examples(spark, sf))))
    row = counts.agg(F.array_sort(F.collect_list(F.struct("split", "examples", "signatures"))).alias("splits"))  # a row a split
    path = f"{shared_dir(spark)}/MANIFEST.json"
    sinks.write_document(row, path)
    read = records.read_json_document(spark, path).select(F.explode("splits").alias("s"))
    return read.select("s.split", "s.examples", "s.signatures")


@query("select n_nationkey, n_nationkey % 3 <> 0 as use_tsd, case when n_nationkey % 3 <> 0 then n_nationkey * 0.5::double end as lam, case when n_nationkey % 3 <> 0 then 'ast' end as tree from nation")
def sidecars(spark, sf):
    """Parameters beside models, one a nation; a model without them is the baseline."""
    base = shared_dir(spark)
    n = X.table(spark, sf, "nation").select("n_nationkey", F.concat(F.lit(f"{base}/model-"), F.col("n_nationkey").cast("string")).alias("folder"))
    given = n.where("n_nationkey % 3 != 0").select("folder", F.lit(True).alias("use_tsd"), (F.col("n_nationkey") * F.lit(0.5)).alias("lam"), F.lit("ast").alias("tree"))
    sinks.write_sidecars(given)
    read = sinks.read_sidecars(n, f"{base}/*", "use_tsd boolean, lam double, tree string")
    return read.select("n_nationkey", "use_tsd", "lam", "tree")


@query("""with f as (select 'blocker' as severity from labels where toxic = 1 union all select 'major' from labels where quality = 0)
select severity, count(*) as n, round(count(*) * case severity when 'blocker' then 1.0::double else 0.4::double end, 6) as cost, true as same_version from f group by 1""")  # fmt: skip
def contract_costs(spark, sf):
    """What the findings of each severity cost by a contract read from the first source that has one, and whether its version is the one expected."""
    path = f"{shared_dir(spark)}/contract.json"
    sinks.write_once({"version": records.CONTRACT_VERSION, **records.CONTRACT}, path)
    contract = records.first_of(lambda: records.json_document(f"{path}.missing"), lambda: records.json_document(path), lambda: records.CONTRACT)
    weights = spark.createDataFrame(list(contract["vocab"]["severity_weight"].items()), "severity string, weight double")  # a row a severity
    counts = X.findings(spark, sf).groupBy("severity").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(weights), "severity", "left")
    same = F.lit(records.check_version(contract))
    return counts.select("severity", "n", F.round(F.col("n") * F.coalesce("weight", F.lit(0.0)), 6).alias("cost"), same.alias("same_version"))


@query("""select c_custkey, 'own' || c_custkey as own, 'base' || c_nationkey as inherited, case when c_custkey % 2 = 0 then c_name else '[1, 2]' end as replaced, case when c_custkey % 3 = 0 then 5 else 1 end as deep from customer""")
def merged_configurations(spark, sf):
    """A configuration a customer, merged over that of its nation: nested maps merge, anything else replaces."""
    k, n = (F.col(c).cast("string") for c in ("c_custkey", "c_nationkey"))
    base = F.concat(F.lit('{"a": {"own": "x", "inherited": "base'), n, F.lit('"}, "b": [1, 2], "c": {"d": {"e": 1}}}'))
    own = F.concat(F.lit('{"a": {"own": "own'), k, F.lit('"}'), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(', "b": "'), "c_name", F.lit('"'))).otherwise(""))
    own = F.concat(own, F.when(F.col("c_custkey") % 3 == 0, ', "c": {"d": {"e": 5}}').otherwise(""), F.lit("}"))
    rows = X.table(spark, sf, "customer").select("c_custkey", records.merged_json(base, own).alias("made"))
    of = lambda path: F.get_json_object("made", path)
    return rows.select("c_custkey", of("$.a.own").alias("own"), of("$.a.inherited").alias("inherited"), F.replace(of("$.b"), F.lit("[1,2]"), F.lit("[1, 2]")).alias("replaced"), of("$.c.d.e").cast("int").alias("deep"))


@query("select item_id, '## Case ' || item_id as head from benchmark")
def written_case_report(spark, sf):
    """The report of all cases, written as one file in order and read again: the place of each case's head."""
    b = X.table(spark, sf, "benchmark")
    path = f"{shared_dir(spark)}/cases.md"
    block = sinks.case_block(F.col("item_id"), F.col("text"), F.lower("text"), F.lower("text"), F.col("text"))
    sinks.write_report(b.select("item_id", block.alias("block")), path, "item_id")
    lines = records.physical_lines(spark, path).where(F.col("value").startswith("## Case "))
    return lines.select(F.substring("value", 9, 20).cast("long").alias("item_id"), F.col("value").alias("head"))


# ---- binary files: written by one data source, read again by byte ranges ----


def _tensor_files(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The tensors of two models, each read from its files in pieces."""
    binary.register(spark)
    e = X.table(spark, sf, "embeddings")
    name = F.concat(F.lit("t"), F.col("vec_id").cast("string")).alias("name")
    changed = F.transform("embedding", lambda v: F.when(F.col("vec_id") % 4 == 0, v * F.lit(1.5).cast("float")).otherwise(v))
    sides = []
    for rows in (e.where("vec_id % 50 != 7").select(name, F.col("embedding").alias("values")), e.select(name, changed.alias("values"))):
        path = shared_dir(spark)
        rows.write.format("tensors").mode("overwrite").save(path)
        sides.append(spark.read.format("tensors").option("piece", 128).load(path))  # 32 numbers a piece, so that tensors are in several
    return sides[0], sides[1]


@query(_TENSORS + "select 't' || vec_id as name, in_both, round(case when in_both then d end, 5) as max_diff from c")
def tensor_changes_of_files(spark, sf):
    return metrics.tensor_changes(*_tensor_files(spark, sf)).withColumn("max_diff", F.round("max_diff", 5))


@query(_TENSORS + "select count(*) as n, bool_and(in_both) as same_names, sum((in_both and d = 0)::bigint)::bigint as unchanged, round(max(case when in_both then d end), 5) as max_diff, bool_and(in_both) and sum((in_both and d = 0)::bigint) / count(*) < 0.5 and max(case when in_both then d end) > 1e-6 as moved from c")
def tensor_verdict_of_files(spark, sf):
    return metrics.tensor_verdict(metrics.tensor_changes(*_tensor_files(spark, sf))).withColumn("max_diff", F.round("max_diff", 5))


@query(_TENSORS + "select 't' || vec_id as name, round(d, 5) as max_diff from c where in_both order by d desc, 't' || vec_id limit 5")
def most_changed_of_files(spark, sf):
    changes = metrics.tensor_changes(*_tensor_files(spark, sf))
    return changes.where("in_both").orderBy(F.desc("max_diff"), "name").limit(5).select("name", F.round("max_diff", 5).alias("max_diff"))


@query("select sum(len(embedding))::bigint as parameters, count(*) as tensors, sum((len(embedding) + 31) // 32)::bigint as pieces from embeddings")
def parameter_count_of_files(spark, sf):
    t = _tensor_files(spark, sf)[1]
    return metrics.parameters(t).crossJoin(F.broadcast(t.agg(F.countDistinct("name").alias("tensors"), F.count(F.lit(1)).alias("pieces"))))  # single rows


@query("""select s_suppkey, 'arch' || s_suppkey % 4 as arch, 2 + (s_suppkey % 2)::bigint as tensors, (s_suppkey % 2)::bigint as ssm, case when s_suppkey % 5 = 4 then 0 else (s_suppkey % 3 = 0)::bigint end as recurrent, s_suppkey % 7 <> 0 as template,
 not (s_suppkey % 3 = 0 and s_suppkey % 5 <> 4 and s_suppkey % 2 = 0) and s_suppkey % 7 <> 0 as valid from supplier""")  # fmt: skip
def export_validity_of_files(spark, sf):
    """The verdict on exported models, a header file each: a list of head counts, a single number, none of the own architecture."""
    binary.register(spark)
    k = F.col("s_suppkey")
    entry = lambda key, kind, value: F.struct(F.lit(key).alias("key") if isinstance(key, str) else key.alias("key"), F.lit(kind).alias("kind"), value.alias("value"))
    arch = F.concat(F.lit("arch"), (k % 4).cast("string"))
    count = F.concat(arch, F.lit(".attention.head_count_kv"))
    listed = F.concat(F.lit("[8, "), (k % 3).cast("string"), F.lit("]"))
    heads = F.when(k % 5 == 4, F.array(entry("other.attention.head_count_kv", "array", F.lit("[0]")))).when(k % 5 == 3, F.array(entry(count, "uint32", (k % 3).cast("string")))).otherwise(F.array(entry(count, "array", listed)))
    keys = F.concat(F.array(entry("general.architecture", "string", F.concat(F.lit('"'), arch, F.lit('"')))), heads, F.when(k % 7 != 0, F.array(entry("tokenizer.chat_template", "string", F.lit('"{{ x }}"')))).otherwise(F.array()))
    tensor = lambda name: F.struct(F.lit(name).alias("name"), F.array(F.lit(4).cast("long"), F.lit(2).cast("long")).alias("shape"), F.lit(0).alias("kind"))
    tensors = F.concat(F.array(tensor("blk.0.attn_k.weight"), tensor("output.weight")), F.when(k % 2 == 1, F.array(tensor("blk.0.ssm_in.weight"))).otherwise(F.array()))
    path = shared_dir(spark)
    files = X.table(spark, sf, "supplier").select(F.concat(F.lit("model-"), k.cast("string"), F.lit(".gguf")).alias("file"), keys.alias("keys"), tensors.alias("tensors"))
    files.write.format("exports").mode("overwrite").save(path)
    found = runs.exports(spark.read.format("exports").load(path), spark.read.format("exports").option("part", "tensors").load(path))
    return found.select(F.regexp_extract("path", r"model-(\d+)\.gguf$", 1).cast("long").alias("s_suppkey"), "arch", "tensors", "ssm", "recurrent", "template", "valid")
