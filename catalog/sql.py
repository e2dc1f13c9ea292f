"""The same results by definition, as SQL on the given tables."""

from __future__ import annotations

from catalog.tables import Spec, model_spec, text_model_spec

SQL: dict[str, str] = {}



def _model(spec: Spec) -> str:
    """Parameters (name, row, v) of a model made of the given vectors."""
    return (
        "select name, row, flatten(list(case when name like '%LayerNorm.weight' "
        "then list_transform(cast(embedding as double[]), lambda x: x + 1.0) else cast(embedding as double[]) end "
        "order by part)) as v from (values "
        + ", ".join(str(line) for line in spec)
        + """) s(name, first, n_rows, joined), range(400) r(row), range(4) p(part), embeddings
        where row < n_rows and part < joined
        and vec_id = (first + row * joined + part) % (select count(*) from embeddings) group by name, row"""
    )


# Building blocks, each a named subquery with the ones it needs.
BLOCKS = {
    "purchases": (
        [],
        """select r_name as market, o_custkey as user_id, l_partkey as item_id,
        date_diff('day', date '1970-01-01', cast(o_orderdate as date)) * 86400 as ts_sec, l_orderkey, l_linenumber
        from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
        join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
    ),
    "clicks": (
        [],
        """select user_id, cast(json_extract_string(props, '$.k') as bigint) as item_id, event_type, ts from events""",
    ),
    "metadata": (
        [],
        """select p_partkey as item_id, p_name as title,
        case when p_size % 3 = 0 then cast([] as varchar[]) else [p_type, p_brand] end as description from part""",
    ),
    "vectors": (
        [],
        """select p_partkey as item_id, cast(embedding as double[]) as v from part
        join embeddings on vec_id = p_partkey % (select count(*) from embeddings)""",
    ),
    "positions": (
        ["purchases"],
        """select *, row_number() over (partition by market, user_id
            order by ts_sec, l_orderkey, l_linenumber, item_id) as pos,
        count(*) over (partition by market, user_id) as n_events from purchases""",
    ),
    "split": (
        ["positions"],
        """select *, case when pos = n_events and n_events >= 3 then 'test'
            when pos = n_events - 1 and n_events >= 4 then 'valid' else 'train' end as phase
        from positions where pos >= 2""",
    ),
    "prefixes": (
        ["positions"],
        """select *, list(item_id) over (partition by market, user_id
            order by ts_sec, l_orderkey, l_linenumber, item_id rows between 50 preceding and 1 preceding) as seq
        from positions""",
    ),
    "latest": (
        ["positions"],
        """select market, user_id, list(item_id order by pos) as seq, count(*) as n
        from positions where pos > n_events - 50 group by market, user_id""",
    ),
    "ids": (
        ["purchases"],
        """select market, item_id, row_number() over (partition by market order by item_id) as iid,
        count(*) over (partition by market) as n_items from (select distinct market, item_id from purchases)""",
    ),
    "freq": (
        ["ids", "split"],
        """select ids.market, ids.item_id, iid, count(s.item_id) as freq from ids
        left join (select market, item_id from split where phase = 'train') s
        on s.market = ids.market and s.item_id = ids.item_id group by all""",
    ),
    "weights": (["freq"], "select *, 1.2 - tanh(0.99 * freq - 0.99) as weight from freq"),
    "targets": (
        ["split", "positions", "vectors"],
        """select s.market, s.user_id, s.phase, s.item_id, p.item_id as last_item, v as seq_v
        from split s join positions p on p.market = s.market and p.user_id = s.user_id and p.pos = s.pos - 1
        join vectors on vectors.item_id = p.item_id where s.phase <> 'train'""",
    ),
    "drawn": (
        ["targets", "ids"],
        """select t.*, iid as positive, k,
        cast('0x' || substr(md5('7|' || t.market || '|' || user_id || '|' || phase || '|' || k), 1, 15) as bigint)
            % (n_items - 1) + 1 as place
        from targets t join ids on ids.market = t.market and ids.item_id = t.item_id, range(1, 100) r(k)""",
    ),
    "candidates": (
        ["drawn"],
        """select market, user_id, phase, positive, positive as candidate from drawn
        union select market, user_id, phase, positive, case when place >= positive then place + 1 else place end
        from drawn""",
    ),
    "scored": (
        ["candidates", "targets", "ids", "vectors"],
        """select c.*, round(list_dot_product(seq_v, v), 9) as score from candidates c
        join targets t on t.market = c.market and t.user_id = c.user_id and t.phase = c.phase
        join ids on ids.market = c.market and ids.iid = c.candidate join vectors on vectors.item_id = ids.item_id""",
    ),
    "ranks": (
        ["scored"],
        """select c.market, c.user_id, c.phase, c.positive,
        1 + count(*) filter (c.score > p.score or (c.score = p.score and c.candidate < c.positive)) as rank
        from scored c join scored p on p.market = c.market and p.user_id = c.user_id and p.phase = c.phase
        and p.candidate = c.positive group by all""",
    ),
    "metrics": (
        ["ranks"],
        """select market, phase, metric, k, round(avg(case when rank > k then 0.0
            when metric = 'MRR' then 1.0 / rank else 1.0 / log2(rank + 1.0) end), 4) as value
        from ranks, (values ('MRR'), ('NDCG')) m(metric), (values (5::bigint), (10::bigint), (20::bigint)) t(k)
        group by all""",
    ),
    "offered": (["ids", "vectors"], "select market, item_id, v from ids join vectors using (item_id)"),
    "logits": (
        ["targets", "offered"],
        """select t.market, t.user_id, t.item_id, o.item_id as other, list_dot_product(seq_v, v) as score
        from targets t join offered o on o.market = t.market where t.phase = 'test'""",
    ),
    "nll": (
        ["logits"],
        """select market, user_id, item_id, max(score) filter (other = item_id) as own,
        ln(sum(exp(score))) as lse from logits group by all""",
    ),
    "attention": (
        ["positions", "vectors"],
        """select k.market, k.user_id, k.pos, k.n_events, k.item_id, kv.v,
        exp(list_dot_product(qv.v, kv.v) / sqrt(len(qv.v))) as e
        from positions k join positions q on q.market = k.market and q.user_id = k.user_id and q.pos = q.n_events
        join vectors kv on kv.item_id = k.item_id join vectors qv on qv.item_id = q.item_id
        where k.pos > k.n_events - 50""",
    ),
    "attended": (
        ["attention"],
        """select market, user_id, pos - greatest(n_events - 50, 0) - 1 as place, item_id, v,
        e / sum(e) over (partition by market, user_id) as weight from attention""",
    ),
    "layered": (
        [],
        """select vec_id // 192 as layer, ['query', 'key', 'value'][(vec_id // 64) % 3 + 1] as kind,
        vec_id % 64 as row, cast(embedding as double[]) as v from embeddings""",
    ),
    "chosen": (
        ["layered"],
        """select kind as weight, row, v from layered
        where layer = (select max(layer) from layered) and kind in ('query', 'key')""",
    ),
    "model": ([], _model(model_spec())),
}


# Made once, so that no join order builds a table of all pairs.
MATERIALIZED = {"offered", "encoded", "targets"}


def _with(names: str, blocks: dict[str, tuple[list[str], str]]) -> str:
    """The named blocks and what they need, in order."""
    done: list[str] = []

    def add(name: str) -> None:
        for other in blocks[name][0]:
            add(other)
        if name not in done:
            done.append(name)

    for name in names.split():
        add(name)
    kept = {n: " materialized" if n in MATERIALIZED else "" for n in done}
    return "with " + ",\n".join(f"{n} as{kept[n]} ({blocks[n][1]})" for n in done) + "\n"


def digits(vector: str) -> str:
    """All places of a vector as whole millionths, in one text."""
    return f"array_to_string(list_transform({vector}, lambda x: cast(round(x * 1e6) as bigint)), ' ')"


def define(name: str, names: str, select: str, extra: dict[str, tuple[list[str], str]] | None = None) -> None:
    SQL[name] = (_with(names, BLOCKS | (extra or {})) if names else "") + select


define("item_text", "metadata", "select item_id, title || ' ' || coalesce(description[1], '') as text_feature from metadata")
define("dedup_first", "metadata", "select item_id, title, item_id as ord from metadata")
define(
    "items_semi_join",
    "metadata clicks",
    "select item_id, title from metadata where item_id in (select item_id from clicks)",
)
define(
    "epoch_seconds",
    "",
    "select o_orderkey, cast(epoch(cast(o_orderdate as date)) as bigint) as ts_sec from orders",
)
define("interactions", "purchases", "select market, user_id, item_id, ts_sec from purchases")
define(
    "coverage_report",
    "purchases metadata",
    """, flawed as (select item_id, case when item_id % 50 <> 11 then title end as title,
        case when item_id % 50 <> 13 then description end as description
        from metadata, range(2) r(again) where item_id % 50 <> 7 and (again = 0 or item_id % 50 = 3)),
    bought as (select distinct item_id from purchases)
    select (select count(*) from bought) as n_items,
    (select count(*) from bought where item_id not in (select item_id from flawed)) as n_missing,
    (select count(*) from (select item_id from flawed where item_id in (select item_id from bought)
        group by 1 having count(*) > 1)) as n_duplicated,
    (select count(*) from flawed where title is null and item_id in (select item_id from bought)) as n_no_title,
    (select count(*) from flawed where description is null and item_id in (select item_id from bought)) as n_no_description""",
)
define(
    "missing_items",
    "purchases metadata",
    """select distinct item_id from purchases
    where item_id not in (select item_id from metadata where len(description) > 0)""",
)
define(
    "market_items",
    "purchases vectors",
    """select market, item_id, round(list_dot_product(v, list_transform(range(1, len(v) + 1), lambda i: i::double)), 6)
    + 0.0 as checksum from (select distinct market, item_id from purchases) join vectors using (item_id)""",
)
define("market_item_sets", "purchases", "select distinct market, item_id from purchases")
define("all_items", "purchases", "select distinct item_id from purchases")
define(
    "market_stats",
    "purchases",
    """select market, count(*) as n_rows, count(distinct user_id) as n_users, count(distinct item_id) as n_items,
    min(n) as min_events, max(n) as max_events, round(count(*) / count(distinct user_id), 6) + 0.0 as avg_events
    from (select *, count(*) over (partition by market, user_id) as n from purchases) group by market""",
)
for _name, _column in (("market_overlap", "item_id"), ("user_overlap", "user_id")):
    define(
        _name,
        "purchases",
        f""", own as (select distinct market, {_column} as x from purchases),
        n as (select market, count(*) as n from own group by 1),
        common as (select a.market as a, b.market as b, count(*) as n from own a join own b using (x) group by all)
        select a.market as market_a, b.market as market_b, coalesce(common.n, 0) as n_common,
        round(coalesce(common.n, 0) / (a.n + b.n - coalesce(common.n, 0)), 6) + 0.0 as jaccard
        from n a join n b on a.market < b.market left join common on common.a = a.market and common.b = b.market""",
    )
define(
    "event_positions",
    "positions",
    """select market, user_id, item_id, ts_sec, l_orderkey, l_linenumber::bigint as l_linenumber, pos, n_events
    from positions""",
)
define(
    "click_positions",
    "clicks",
    """select user_id, item_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as at,
    row_number() over (partition by user_id order by ts, item_id) as pos,
    count(*) over (partition by user_id) as n_events from clicks""",
)
define(
    "prefix_sequences",
    "prefixes",
    """select market, user_id, pos, item_id, array_to_string(seq, ' ') as seq, len(seq) as item_length
    from prefixes where pos > 1""",
)
define(
    "click_sequences",
    "clicks",
    """select user_id, pos, item_id, array_to_string(seq, ' ') as seq, array_to_string(types, ' ') as types from (
    select user_id, item_id, row_number() over w as pos,
    list(item_id) over (partition by user_id order by ts, item_id, event_type rows between 50 preceding and 1 preceding) as seq,
    list(event_type) over (partition by user_id order by ts, item_id, event_type
        rows between 50 preceding and 1 preceding) as types
    from clicks window w as (partition by user_id order by ts, item_id, event_type)) where pos > 1""",
)
define("loo_split", "split", "select market, user_id, pos, item_id, phase from split")
define(
    "target_rows",
    "prefixes",
    """select market, user_id, case when pos = n_events then 'test' else 'valid' end as phase, item_id,
    array_to_string(seq, ' ') as seq from prefixes
    where (pos = n_events and n_events >= 3) or (pos = n_events - 1 and n_events >= 4)""",
)
define("latest_sequence", "latest", "select market, user_id, array_to_string(seq, ' ') as seq, n as item_length from latest")
define("item_ids", "ids", "select market, item_id, iid, n_items from ids")
_PADDED = """select market, iid, freq from freq
union all select distinct market, 0::bigint, 0::bigint from freq"""
define("item_freq", "freq", _PADDED)
define("train_item_freq", "freq", _PADDED)
define("item_weights", "weights", "select market, item_id, iid, freq, round(weight, 6) + 0.0 as weight from weights")
define("ce_loss", "nll", "select market, count(*) as n_rows, round(avg(lse - own), 6) + 0.0 as loss from nll group by 1")
define(
    "ce_loss_padded",
    "nll",
    "select market, count(*) as n_rows, round(avg(ln(exp(lse) + 1.0) - own), 6) + 0.0 as loss from nll group by 1",
)
define(
    "wce_loss",
    "nll weights",
    """select market, count(*) as n_rows, round(sum(weight * (lse - own)) / sum(weight), 6) + 0.0 as loss
    from nll join weights using (market, item_id) group by 1""",
)
# Rows with the same last item share their sum over all items.
_TRAIN = {
    "train": (
        ["positions", "split"],
        """select s.*, before from split s join (select market, user_id, pos,
            lag(item_id) over (partition by market, user_id order by pos) as before from positions) b
        using (market, user_id, pos) where phase = 'train'""",
    ),
    "sums": (
        ["train", "ids", "vectors"],
        """select t.market, t.before, ln(sum(exp(list_dot_product(a.v, b.v)))) as lse
        from (select distinct market, before from train) t join vectors a on a.item_id = t.before
        join ids on ids.market = t.market join vectors b on b.item_id = ids.item_id group by all""",
    ),
    "train_nll": (
        ["train", "sums", "vectors"],
        """select t.market, t.item_id, lse - list_dot_product(a.v, b.v) as nll from train t
        join sums using (market, before) join vectors a on a.item_id = t.before join vectors b on b.item_id = t.item_id""",
    ),
    "train_drawn": (
        ["train", "ids", "vectors"],
        """select t.market, p.v as pos_v, a.v as seq_v, iid,
        cast('0x' || substr(md5('7|' || t.market || '|' || user_id || '|' || pos || '|1'), 1, 15) as bigint)
            % (n_items - 1) + 1 as place
        from train t join ids using (market, item_id) join vectors a on a.item_id = t.before
        join vectors p on p.item_id = t.item_id""",
    ),
}
# Blocks and select of each loss over training rows.
_TRAIN_LOSSES = {
    "ce": ("train_nll", "select market, count(*) as n_rows, round(avg(nll), 6) + 0.0 as loss from train_nll group by 1"),
    "wce": (
        "train_nll weights",
        """select market, count(*) as n_rows, round(sum(weight * nll) / sum(weight), 6) + 0.0 as loss
        from train_nll join weights using (market, item_id) group by 1""",
    ),
    "bpr": (
        "train_drawn ids vectors",
        """select d.market, count(*) as n_rows, round(avg(ln(1.0 + exp(
            round(list_dot_product(seq_v, n.v), 9) - round(list_dot_product(seq_v, pos_v), 9)))), 6) + 0.0 as loss
        from train_drawn d join ids on ids.market = d.market and ids.iid = case when place >= d.iid then place + 1 else place end
        join vectors n on n.item_id = ids.item_id group by 1""",
    ),
}
for _name in ("ce", "wce", "bpr"):
    define(f"train_{_name}_loss", *_TRAIN_LOSSES[_name], _TRAIN)
define(
    "log_softmax",
    "scored",
    """select market, user_id, candidate,
    round(score - ln(sum(exp(score)) over (partition by market, user_id)), 6) + 0.0 as log_p
    from scored where phase = 'test'""",
)
define(
    "grouped_log_softmax",
    "scored",
    """select market, user_id, candidate, round(score - ln(sum(exp(score)) over (partition by market)), 6) + 0.0 as log_p
    from scored where phase = 'test'""",
)
define(
    "mapped_weights",
    "purchases weights",
    """select market, user_id, item_id, iid, round(weight, 6) + 0.0 as weight from purchases join weights using (market, item_id)""",
)
define(
    "bpr_loss",
    "drawn ids vectors",
    """select market, count(*) as n_rows, round(avg(-ln(1.0 / (1.0 + exp(neg - pos)))), 6) + 0.0 as loss from (
    select d.market, round(list_dot_product(d.seq_v, p.v), 9) as pos, round(list_dot_product(d.seq_v, n.v), 9) as neg
    from drawn d join vectors p on p.item_id = d.item_id
    join ids on ids.market = d.market and ids.iid = case when d.place >= d.positive then d.place + 1 else d.place end
    join vectors n on n.item_id = ids.item_id where d.k = 1 and d.phase = 'test') group by 1""",
)
define(
    "uniform_negatives", "candidates", "select market, user_id, positive, candidate from candidates where phase = 'test'"
)
define(
    "unseen_negatives",
    "candidates ids purchases",
    """select market, user_id, positive, candidate from candidates c where phase = 'test' and (candidate = positive
    or not exists (select 1 from purchases p join ids using (market, item_id)
        where p.market = c.market and p.user_id = c.user_id and ids.iid = c.candidate))""",
)
define(
    "pair_scores",
    "positions vectors",
    """, pairs as (select market, user_id, pos, item_id, lag(item_id) over (partition by market, user_id order by pos) as before
        from positions)
    select market, user_id, pos, b.item_id, round(list_dot_product(va.v, vb.v), 6) + 0.0 as score
    from pairs b join vectors va on va.item_id = before join vectors vb on vb.item_id = b.item_id""",
)
define(
    "vector_lookup",
    "purchases vectors",
    f"select market, user_id, item_id, {digits('v')} as v from purchases join vectors using (item_id)",
)
define(
    "dense_item_features",
    "ids vectors metadata",
    f"""select market, iid, {digits('v')} as v from ids left join (select * from vectors
        where item_id in (select item_id from metadata where len(description) > 0)) using (item_id)
    union all select distinct market, 0::bigint, null::varchar from ids""",
)
define("rank_positive", "ranks", "select market, user_id, positive, rank from ranks where phase = 'test'")
define("ranking_metrics", "metrics", "select * from metrics where phase = 'test'")
define("validation_metrics", "metrics", "select * from metrics where phase = 'valid'")
define(
    "metric_report",
    "metrics",
    """select market, phase, string_agg(printf('%.4f', value), ' ' order by metric, k) as line
    from metrics where phase = 'test' group by all""",
)
define(
    "best_run",
    "metrics",
    """select market as run, value from metrics where phase = 'valid' and metric = 'MRR' and k = 10
    order by value desc, market limit 1""",
)
define(
    "full_sort_top_items",
    "",
    """select vec_id, item_id, s + 0.0 as score, rank from (
    select vec_id, item_id, s, row_number() over (partition by vec_id order by s desc, item_id) as rank from (
    select a.vec_id, b.vec_id as item_id, round(list_dot_product(a.embedding::double[], b.embedding::double[]), 9) as s
    from embeddings a, embeddings b)) where rank <= 10""",
)
define(
    "market_top_items",
    "positions ids vectors",
    """select market, user_id, item_id, s + 0.0 as score, rank from (
    select market, user_id, item_id, s, row_number() over (partition by market, user_id order by s desc, item_id) as rank
    from (select p.market, p.user_id, ids.item_id, round(list_dot_product(q.v, k.v), 9) as s
    from positions p join vectors q on q.item_id = p.item_id join ids on ids.market = p.market
    join vectors k on k.item_id = ids.item_id where p.pos = p.n_events)) where rank <= 10""",
)
for _name in ("loo_split", "latest_sequence"):
    SQL[f"bucketed_{_name}"] = SQL[_name]
SQL["mapped_top_items"] = SQL["market_top_items"]
define(
    "text_vectors",
    "",
    r"""select doc_id, bucket, round(n / sqrt(sum(n * n) over (partition by doc_id)), 6) + 0.0 as weight from (
    select doc_id, cast('0x' || substr(md5(w), 1, 8) as bigint) % 64 as bucket, count(*)::double as n from (
    select doc_id, unnest(string_split_regex(lower(text), '[^\p{L}\p{N}]+')) as w from documents)
    where w <> '' group by all)""",
)
# Hashed vectors of item texts, stored as single-precision numbers.
BLOCKS["hashed"] = (
    ["metadata"],
    r"""select item_id, list_transform(range(64), lambda i: cast(cast(
        len(list_filter(b, lambda x: x = i))::double / sqrt(list_sum(list_transform(range(64),
            lambda k: len(list_filter(b, lambda x: x = k))::double * len(list_filter(b, lambda x: x = k))))) as float) as double)) as v
    from (select item_id, list_transform(list_filter(string_split_regex(lower(title || ' ' || coalesce(description[1], '')),
        '[^\p{L}\p{N}]+'), lambda w: w <> ''), lambda w: cast('0x' || substr(md5(w), 1, 8) as bigint) % 64) as b from metadata)""",
)
define("item_text_vectors", "hashed", f"select item_id, {digits('v')} as v from hashed")
define(
    "prepared_tables",
    "purchases hashed",
    f"select market, user_id, item_id, ts_sec, {digits('v')} as v from purchases join hashed using (item_id)",
)
define(
    "attention_weights",
    "attended",
    "select market, user_id, place, item_id, round(weight, 6) + 0.0 as weight from attended",
)
define(
    "attention_top_item",
    "attended",
    """select market, user_id, item_id, place, w as top_weight from (select market, user_id, item_id, place,
    round(weight, 6) + 0.0 as w, row_number() over (partition by market, user_id order by round(weight, 6) desc, place desc) as k
    from attended) where k = 1""",
)
define(
    "attention_pool",
    "attended",
    """select market, user_id, d.place, round(sum(weight * v[d.place + 1]), 6) + 0.0 as value
    from attended, range(64) d(place) group by all""",
)


_ATT, _FF = "trm_encoder.layer.multi_head_attention.", "trm_encoder.layer.feed_forward."


def _linear(source: str, name: str, relu: bool = False) -> str:
    """Rows of `source` (id, v) times a matrix, plus bias."""
    value = "list_dot_product(w.v, s.v) + b.v[w.row + 1]"
    value = f"greatest({value}, 0.0)" if relu else value
    return f"""select s.id, list({value} order by w.row) as v from {source} s, params w, params b
        where w.name = '{name}.weight' and b.name = '{name}.bias' group by s.id"""


def _norm(source: str, name: str) -> str:
    """Layer norm of rows of `source` (id, v)."""
    return f"""select n.id, list_transform(list_zip(n.v, w.v, b.v), lambda z: (z[1] - m) / sqrt(s + 1e-12) * z[2] + z[3])
        as v from (select id, v, m, list_avg(list_transform(v, lambda x: (x - m) * (x - m))) as s
        from (select id, v, list_avg(v) as m from {source})) n, params w, params b
        where w.name = '{name}.weight' and b.name = '{name}.bias'"""


def _added(left: str, right: str) -> str:
    return f"""select l.id, list_transform(list_zip(l.v, r.v), lambda z: z[1] + z[2]) as v
        from {left} l join {right} r on r.id = l.id"""


def _gelu(a: str) -> str:
    """a * (1 + erf(a / sqrt 2)) / 2; erf by its series of positive terms, which sums to 1 far out."""
    z = f"(abs({a}) / sqrt(2.0))"
    term = f"exp(n * 2 * ln(2.0) + lgamma(n + 1.0) - lgamma(2.0 * n + 2) + (2 * n + 1) * ln({z}) - {z} * {z})"
    erf = f"2 / sqrt(pi()) * list_sum(list_transform(range(120), lambda n: {term}))"
    return f"case when {a} = 0 then 0.0 when {z} > 5 then greatest({a}, 0.0) else 0.5 * {a} * (1 + sign({a}) * {erf}) end"


#: As many terms of the series as the size of `a` asks for.
_SHORT = "cast(20 + 4 * (abs(a) / sqrt(2.0)) * (abs(a) / sqrt(2.0)) as bigint)"


def encoder_blocks(places: tuple[list[str], str], model: tuple[list[str], str]) -> dict[str, tuple[list[str], str]]:
    """The encoder on `places` (market, user_id, place from 1, is_last, v); result: encoded (market, user_id, v)."""
    return {
        "params": model,
        "places": places,
        "numbered": (["places"], "select *, row_number() over (order by market, user_id, place) as id from places"),
        "input": (
            ["numbered", "params"],
            """select n.id, list_transform(list_zip(n.v, p.v), lambda z: z[1] + z[2]) as v from numbered n
            join params p on p.name = 'position_embedding.weight' and p.row = n.place - 1""",
        ),
        "x": (["input"], _norm("input", "LayerNorm")),
        "last": (["x", "numbered"], "select id, x.v from x join numbered using (id) where is_last"),
        "q0": (["last"], _linear("last", _ATT + "query")),
        "q": (["q0"], _linear("q0", _ATT + "mlp_query.mlp_layers.1", relu=True)),
        "k0": (["x"], _linear("x", _ATT + "key")),
        "k": (["k0"], _linear("k0", _ATT + "mlp_key.mlp_layers.1", relu=True)),
        "v": (["x"], _linear("x", _ATT + "value")),
        "asked": (
            ["numbered", "q", "k", "v"],
            """select l.id, h, v.v[h * 16 + 1 : h * 16 + 16] as hv,
            exp(list_dot_product(q.v[h * 16 + 1 : h * 16 + 16], k.v[h * 16 + 1 : h * 16 + 16]) / 4.0) as e
            from numbered l join numbered n on n.market = l.market and n.user_id = l.user_id join q on q.id = l.id
            join k on k.id = n.id join v on v.id = n.id, range(4) r(h) where l.is_last""",
        ),
        "context": (
            ["asked"],
            """select id, list(c order by h, d) as v from (
            select id, h, d, sum(e * hv[d + 1]) / sum(e) as c from asked, range(16) r(d) group by all) group by id""",
        ),
        "dense": (["context"], _linear("context", _ATT + "dense")),
        "mixed": (["dense", "last"], _added("dense", "last")),
        "hidden": (["mixed"], _norm("mixed", _ATT + "LayerNorm")),
        "inner1": (["hidden"], _linear("hidden", _FF + "dense_1")),
        # One row per number: the terms of a whole list at once would not fit into memory.
        "inner2": (
            ["inner1"],
            f"""select id, list({_gelu('a')} order by i) as v from (
            select id, unnest(v) as a, generate_subscripts(v, 1) as i from inner1) group by id""",
        ),
        "inner3": (["inner2"], _linear("inner2", _FF + "dense_2")),
        "mixed2": (["inner3", "hidden"], _added("inner3", "hidden")),
        "output": (["mixed2"], _norm("mixed2", _FF + "LayerNorm")),
        "encoded": (["output", "numbered"], "select market, user_id, o.v from output o join numbered using (id)"),
    }


define(
    "encode_sequences",
    "encoded",
    "select market, user_id, place, round(v[place + 1], 6) + 0.0 as value from encoded, range(64) r(place)",
    encoder_blocks(
        (
            ["positions", "vectors"],
            """select market, user_id, pos - greatest(n_events - 50, 0) as place, pos = n_events as is_last, v
            from positions join vectors using (item_id) where pos > n_events - 50""",
        ),
        (["model"], "select * from model"),
    ),
)
_TEST_PLACES = (
    ["positions", "vectors"],
    """select market, user_id, pos - greatest(n_events - 51, 0) as place, pos = n_events - 1 as is_last, v
    from positions join vectors using (item_id) where n_events >= 3 and pos between n_events - 50 and n_events - 1""",
)
_TEST_TARGETS = {
    "targets": (
        ["split", "encoded"],
        """select s.market, s.user_id, s.phase, s.item_id, e.v as seq_v from split s
        join encoded e on e.market = s.market and e.user_id = s.user_id where s.phase = 'test'""",
    )
}
define(
    "encoder_metrics",
    "metrics",
    "select * from metrics",
    encoder_blocks(
        _TEST_PLACES,
        (
            ["model", "layered"],
            """select m.name, m.row, coalesce(l.v, m.v) as v from model m left join layered l
            on m.name = 'trm_encoder.layer.multi_head_attention.' || l.kind || '.weight' and l.row = m.row
            and l.kind in ('query', 'key') and l.layer = (select count(*) // 192 - 1 from embeddings)""",
        ),
    )
    | _TEST_TARGETS,
)


def run_sql(run: str, phase: str, back: int, kinds: str) -> str:
    """Metrics of a run on the rows of a phase, whose targets lie `back` events before the last; `kinds` are the matrices taken over."""
    places = f"""select market, user_id, pos - greatest(n_events - {51 + back}, 0) as place, pos = n_events - {1 + back} as is_last, v
        from positions join vectors using (item_id)
        where n_events >= {3 + back} and pos between n_events - {50 + back} and n_events - {1 + back}"""
    model = f"""select m.name, m.row, coalesce(l.v, m.v) as v from model m left join layered l
        on m.name = 'trm_encoder.layer.multi_head_attention.' || l.kind || '.weight' and l.row = m.row
        and l.kind in ({kinds}) and l.layer = (select count(*) // 192 - 1 from embeddings)"""
    targets = f"""select s.market, s.user_id, s.phase, s.item_id, e.v as seq_v from split s
        join encoded e on e.market = s.market and e.user_id = s.user_id where s.phase = '{phase}'"""
    own = encoder_blocks((["positions", "vectors"], places), (["model", "layered"], model)) | {"targets": (["split", "encoded"], targets)}
    own["inner2"] = (own["inner2"][0], own["inner2"][1].replace("range(120)", f"range({_SHORT})"))
    return f"select '{run}' as run, * from ({_with('metrics', BLOCKS | own)} select * from metrics)"


_RUNS = {"own": "''", "query-key": "'query', 'key'", "query-key-value": "'query', 'key', 'value'"}
SQL["selected_run_metrics"] = (
    "with tried as ("
    + " union all ".join(run_sql(run, phase, back, kinds) for run, kinds in _RUNS.items() for phase, back in (("valid", 1), ("test", 0)))
    + """), chosen as (select market, run, value as valid_value, row_number() over (partition by market order by value desc, run) as place
        from tried where phase = 'valid' and metric = 'MRR' and k = 10)
    select market, run, valid_value, metric, k, value from tried join chosen using (market, run) where place = 1 and phase = 'test'"""
)
_OWN_MODEL = encoder_blocks(_TEST_PLACES, (["model"], "select * from model")) | _TEST_TARGETS
define(
    "encoder_ce_loss",
    "nll",
    "select market, count(*) as n_rows, round(avg(lse - own), 6) + 0.0 as loss from nll group by 1",
    _OWN_MODEL,
)
define(
    "encoder_top_items",
    "targets offered",
    """select market, user_id, item_id, s + 0.0 as score, rank from (
    select market, user_id, item_id, s, row_number() over (partition by market, user_id order by s desc, item_id) as rank
    from (select t.market, t.user_id, o.item_id, round(list_dot_product(seq_v, o.v), 6) as s
    from targets t join offered o on o.market = t.market)) where rank <= 10""",
    _OWN_MODEL,
)
# Places of all training targets. Items share the given vectors, so what a place puts into the attention depends on its
# vector and its position alone and is worked out once for each such combination.
_TRAIN_ENCODED = {
    "params": (["model"], "select * from model"),
    "asking": (
        ["split"],
        "select *, row_number() over (order by market, user_id, pos) as id from split where phase = 'train'",
    ),
    "places": (
        ["asking", "positions"],
        """select t.id, s.pos - greatest(t.pos - 50, 1) as j, s.pos = t.pos - 1 as is_last,
        s.item_id % (select count(*) from embeddings) as vid from asking t
        join positions s on s.market = t.market and s.user_id = t.user_id and s.pos < t.pos and s.pos >= t.pos - 50""",
    ),
    "combos": (["places"], "select vid, j, row_number() over (order by vid, j) as cid from (select distinct vid, j from places)"),
    "placed": (["places", "combos"], "select id, is_last, cid from places join combos using (vid, j)"),
    "input": (
        ["combos", "params"],
        """select cid as id, list_transform(list_zip(cast(e.embedding as double[]), p.v), lambda z: z[1] + z[2]) as v
        from combos join embeddings e on e.vec_id = vid join params p on p.name = 'position_embedding.weight' and p.row = j""",
    ),
    "x": (["input"], _norm("input", "LayerNorm")),
    "q0": (["x"], _linear("x", _ATT + "query")),
    "q": (["q0"], _linear("q0", _ATT + "mlp_query.mlp_layers.1", relu=True)),
    "k0": (["x"], _linear("x", _ATT + "key")),
    "k": (["k0"], _linear("k0", _ATT + "mlp_key.mlp_layers.1", relu=True)),
    "v": (["x"], _linear("x", _ATT + "value")),
    "last": (["placed", "x", "q"], "select p.id, x.v, q.v as q from placed p join x on x.id = cid join q on q.id = cid where is_last"),
    "heads": (
        ["placed", "last", "k", "v"],
        """select p.id, h, v.v[h * 16 + 1 : h * 16 + 16] as hv,
        exp(list_dot_product(l.q[h * 16 + 1 : h * 16 + 16], k.v[h * 16 + 1 : h * 16 + 16]) / 4.0) as e
        from placed p join last l using (id) join k on k.id = cid join v on v.id = cid, range(4) r(h)""",
    ),
    "context": (
        ["heads"],
        f"""select id, flatten(list(c order by h)) as v from (
        select id, h, [{", ".join(f"sum(e * hv[{d}]) / sum(e)" for d in range(1, 17))}] as c from heads group by id, h) group by id""",
    ),
    "dense": (["context"], _linear("context", _ATT + "dense")),
    "mixed": (["dense", "last"], _added("dense", "last")),
    "hidden": (["mixed"], _norm("mixed", _ATT + "LayerNorm")),
    "inner1": (["hidden"], _linear("hidden", _FF + "dense_1")),
    "inner2": (
        ["inner1"],
        f"""select id, list({_gelu('a').replace("range(120)", f"range({_SHORT})")} order by i) as v from (
        select id, unnest(v) as a, generate_subscripts(v, 1) as i from inner1) group by id""",
    ),
    "inner3": (["inner2"], _linear("inner2", _FF + "dense_2")),
    "mixed2": (["inner3", "hidden"], _added("inner3", "hidden")),
    "output": (["mixed2"], _norm("mixed2", _FF + "LayerNorm")),
    "encoded": (["output", "asking"], "select a.*, o.v as seq_v from output o join asking a using (id)"),
    "shared": (
        ["ids"],
        """select market, vid, n, cast(embedding as double[]) as v from (
        select market, item_id % (select count(*) from embeddings) as vid, count(*) as n from ids group by all)
        join embeddings on vec_id = vid""",
    ),
    "train_lse": (
        ["encoded", "shared"],
        """select id, ln(sum(n * exp(list_dot_product(seq_v, s.v)))) as lse from encoded e join shared s on s.market = e.market group by id""",
    ),
    "train_nll": (
        ["encoded", "train_lse", "vectors"],
        """select e.market, e.item_id, lse - list_dot_product(seq_v, t.v) as nll from encoded e join train_lse using (id)
        join vectors t on t.item_id = e.item_id""",
    ),
    "train_drawn": (
        ["encoded", "ids", "vectors"],
        """select e.market, p.v as pos_v, seq_v, iid,
        cast('0x' || substr(md5('7|' || e.market || '|' || user_id || '|' || pos || '|1'), 1, 15) as bigint)
            % (n_items - 1) + 1 as place
        from encoded e join ids using (market, item_id) join vectors p on p.item_id = e.item_id""",
    ),
}
for _name in ("ce", "wce", "bpr"):
    define(f"encoder_train_{_name}_loss", *_TRAIN_LOSSES[_name], _TRAIN_ENCODED)


def text_layer(n: int, source: str) -> dict[str, tuple[list[str], str]]:
    """Layer n of the text encoder on `source` (id, v), places of all texts in `spots` (id, item_id, place)."""
    name, at = f"encoder.layer.{n}.", lambda block: f"{block}_{n}"
    sums = ", ".join(f"sum(e * hv[{d}]) / sum(e)" for d in range(1, 17))
    return {
        at("query"): ([source, "params"], _linear(source, name + "attention.self.query")),
        at("key"): ([source, "params"], _linear(source, name + "attention.self.key")),
        at("value"): ([source, "params"], _linear(source, name + "attention.self.value")),
        at("heads"): (
            ["spots", at("query"), at("key"), at("value")],
            f"""select a.id, h, v.v[h * 16 + 1 : h * 16 + 16] as hv,
            exp(list_dot_product(q.v[h * 16 + 1 : h * 16 + 16], k.v[h * 16 + 1 : h * 16 + 16]) / 4.0) as e
            from spots a join spots b using (item_id) join {at("query")} q on q.id = a.id join {at("key")} k on k.id = b.id
            join {at("value")} v on v.id = b.id, range(4) r(h)""",
        ),
        at("context"): (
            [at("heads")],
            f"select id, flatten(list(c order by h)) as v from (select id, h, [{sums}] as c from {at('heads')} group by id, h) group by id",
        ),
        at("dense"): ([at("context")], _linear(at("context"), name + "attention.output.dense")),
        at("mixed"): ([at("dense"), source], _added(at("dense"), source)),
        at("hidden"): ([at("mixed")], _norm(at("mixed"), name + "attention.output.LayerNorm")),
        at("inner"): ([at("hidden")], _linear(at("hidden"), name + "intermediate.dense")),
        at("acted"): (
            [at("inner")],
            f"""select id, list({_gelu('a').replace("range(120)", f"range({_SHORT})")} order by i) as v from (
            select id, unnest(v) as a, generate_subscripts(v, 1) as i from {at("inner")}) group by id""",
        ),
        at("outer"): ([at("acted")], _linear(at("acted"), name + "output.dense")),
        at("added"): ([at("outer"), at("hidden")], _added(at("outer"), at("hidden"))),
        at("out"): ([at("added")], _norm(at("added"), name + "output.LayerNorm")),
    }


# The longest piece at every place of every word, then the way through each word.
_TEXTS = {
    "params": ([], _model(text_model_spec())),
    "spoken": (
        [],
        """select p_partkey as item_id, regexp_extract_all(lower(p_name || ' ' || p_type || ' ' || p_brand), '[a-z0-9]+|[^a-z0-9 ]') as ws
        from part""",
    ),
    "known": (["spoken"], "select distinct unnest(ws) as w from spoken"),
    "letters": (["known"], "select w, unnest(range(1, length(w) + 1)) as i from known"),
    "vocabulary": (
        ["letters"],
        """select piece, row_number() over (order by piece) + 3 as id from (
        select w[1:1] as piece from letters union select w[1:3] from letters
        union select '##' || w[i:i] from letters where i > 1 union select '##' || w[i:i + 1] from letters where i > 1)
        where piece not like '%z%'""",
    ),
    "matches": (
        ["letters", "vocabulary"],
        """select w, i, max(length(piece) - case when i > 1 then 2 else 0 end) as n, arg_max(id, length(piece)) as id
        from letters join vocabulary on case when i > 1 then piece like '##%' and starts_with(w[i:], piece[3:])
            else starts_with(w, piece) end group by w, i""",
    ),
    "way": (
        ["matches"],
        """select w, i, [id] as ids, i + n as next from matches where i = 1
        union all select way.w, m.i, list_append(ids, m.id), m.i + m.n from way join matches m on m.w = way.w and m.i = way.next""",
    ),
    "cut": (
        ["known", "way"],
        "select w, coalesce(ids, [1]) as ids from known left join (select w, ids from way where next = length(w) + 1) using (w)",
    ),
    "worded": (
        ["spoken"],
        "select item_id, unnest(ws) as w, generate_subscripts(ws, 1) as k from spoken",
    ),
    "lines": (
        ["worded", "cut"],
        """select item_id, list_append(list_prepend(2, list_slice(flatten(list(ids order by k)), 1, 14)), 3) as ids
        from worded join cut using (w) group by item_id""",
    ),
    "spots": (
        ["lines"],
        """select *, row_number() over (order by item_id, place) as id from (
        select item_id, unnest(ids) as piece, generate_subscripts(ids, 1) as place from lines)""",
    ),
    "input": (
        ["spots", "params"],
        """select s.id, list_transform(list_zip(w.v, p.v, k.v), lambda z: z[1] + z[2] + z[3]) as v from spots s
        join params w on w.name = 'embeddings.word_embeddings.weight' and w.row = s.piece
        join params p on p.name = 'embeddings.position_embeddings.weight' and p.row = s.place - 1
        join params k on k.name = 'embeddings.token_type_embeddings.weight' and k.row = 0""",
    ),
    "x": (["input"], _norm("input", "embeddings.LayerNorm")),
}
define(
    "encoded_texts",
    "spots out_1",
    f"""select item_id, {digits("list_transform(v, lambda x: cast(cast(x as float) as double))")} as v
    from spots join out_1 using (id) where place = 1""",
    _TEXTS | text_layer(0, "x") | text_layer(1, "out_0"),
)
SQL["encoded_texts"] = SQL["encoded_texts"].replace("with ", "with recursive ", 1)
define("select_weights", "chosen", f"select weight, row, {digits('v')} as v from chosen")
define(
    "transfer_weights",
    "model layered",
    f"""select name, model.row as row, {digits('coalesce(l.v, model.v)')} as v from model left join layered l
    on name = 'trm_encoder.layer.multi_head_attention.' || kind || '.weight' and l.row = model.row
    and layer = (select count(*) // 192 - 1 from embeddings)""",
)
define(
    "vector_text",
    "",
    "select vec_id, place, round(embedding[place + 1]::double, 6) + 0.0 as value from embeddings, range(64) r(place)",
)
define("vector_file", "vectors", f"select item_id, {digits('v')} as v from vectors")
define("prepared_interactions", "purchases", "select market, user_id, item_id, ts_sec from purchases")
define(
    "prepared_items",
    "purchases vectors",
    f"select market, item_id, {digits('v')} as v from (select distinct market, item_id from purchases) join vectors using (item_id)",
)
SQL["typed_source"] = SQL["prepared_items"]
define(
    "master_table",
    "purchases",
    "select market, user_id, item_id, ts_sec, l_orderkey, l_linenumber::bigint as l_linenumber from purchases",
)
define("market_files", "purchases", "select market, user_id, item_id, ts_sec from purchases")
define(
    "metadata_file",
    "metadata purchases",
    """select item_id, title || ' ' || coalesce(description[1], '') as text_feature from metadata
    where item_id in (select item_id from purchases)""",
)
define(
    "ratings_file",
    "",
    """select l_orderkey::varchar as "reviewerID", l_partkey::varchar as asin, l_quantity as ratings,
    strftime(l_shipdate, '%Y-%m-%d') as date from lineitem""",
)
define(
    "params_file",
    "layered",
    f"""select 'trm_encoder.layer.' || layer || '.multi_head_attention.' || kind || '.weight' as name, row,
    {digits('v')} as v from layered""",
)
