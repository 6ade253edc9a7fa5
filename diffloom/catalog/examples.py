"""Masking and example queries, on trim scripts so that SQL can restate them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.masks import collapse_masks, message_mask, span_noise_mask
from ..markers import JAVA_KEYWORDS
from ..operators.filters import STATE_TYPE
from ..operators.vocabulary import ignore_labels
from ..plans import examples as X
from .base import TOKEN_PAIRS, query, sql_draw, sql_join, token_pairs

S, SEP = "chr(31)", "\u001f"


def typed(spark, sf):
    """Token pairs with a corpus type by id."""
    k = F.col("doc_id") % 5
    return token_pairs(spark, sf).withColumn("type", F.when(k == 0, STATE_TYPE).when(k == 1, "ccn")
                                             .otherwise("commitpack"))


SQL_TYPE = f"(CASE doc_id % 5 WHEN 0 THEN '{STATE_TYPE}' WHEN 1 THEN 'ccn' ELSE 'commitpack' END)"


def mask_ctes(src: str, name: str, n: str, share: float, seed: str, short_whole: bool = False) -> str:
    """CTE ``name``: rows of ``src`` plus ``<name>_m``, the mask of ``n`` positions as a string."""
    x = f"({n} * {share}::DOUBLE)"

    def cuts(total, seed_):
        u = sql_draw(seed_, "doc_id", "i")
        return (f"[0] || list_sort(list_transform(list_sort(list_transform(range(1, ({total})::BIGINT), "
                f"lambda i: {{'u': {u}, 'i': i}}))[1:(parts - 1)::BIGINT], lambda z: z.i)) || [({total})::BIGINT]")

    gate = f"{n} > 5 AND fits" if short_whole else "fits"
    return f"""{name}0 AS (SELECT *, greatest(round(({x} - {x} % 2.5) / 2.5), 1) AS mean FROM {src}),
    {name}1 AS (SELECT *, least(greatest(round_even(2.5 * mean, 0), 1), greatest(floor({n} / 1.5::DOUBLE), 1))::BIGINT
        AS total FROM {name}0),
    {name}2 AS (SELECT *, greatest(round_even(total / mean, 0), 1)::BIGINT AS spans FROM {name}1),
    {name}3 AS (SELECT *, ({n} - total >= spans AND total >= spans) AS fits FROM {name}2),
    {name}4 AS (SELECT *, CASE WHEN fits THEN spans ELSE 1 END AS parts FROM {name}3),
    {name}5 AS (SELECT *, {cuts(f'{n} - total', seed + '-keep')} AS kc, {cuts('total', seed + '-noise')} AS nc FROM {name}4),
    {name} AS (SELECT * EXCLUDE (mean, total, spans, fits, parts, kc, nc), CASE WHEN {gate} THEN array_to_string(
        list_transform(range(1, parts + 1), lambda i: repeat('0', kc[i + 1] - kc[i]) || repeat('1', nc[i + 1] - nc[i])), '')
        ELSE repeat('0', {n}) END AS {name}_m FROM {name}5)"""


def sql_collapse(tokens: str, mask: str) -> str:
    """Tokens with each masked run as one sentinel; ``mask`` is a string column."""
    prior = f"('0' || substr({mask}, 1, i))"
    rank = f"((length({prior}) - length(replace({prior}, '01', ''))) // 2)"
    return f"""list_filter(list_transform({tokens}, lambda x, i: CASE WHEN substr({mask}, i, 1) = '0' THEN x
        WHEN i > 1 AND substr({mask}, i - 1, 1) = '1' THEN NULL
        WHEN {rank} <= 99 THEN '<extra_id_' || ({rank} - 1) || '>' END), lambda x: x IS NOT NULL)"""


def framed(body: str, nl: str = "nl") -> str:
    return f"(['<msg>'] || {nl} || ['<' || lang || '>'] || {body})"


def both(inp: str, target: str, src: str) -> str:
    return f"SELECT doc_id, {sql_join(inp, S)} AS input, {sql_join(target, S)} AS target FROM {src}"


def example(builder):
    """A query over one example expression."""
    def run(spark, sf):
        p = typed(spark, sf).select("doc_id", builder().alias("e"))
        return p.select("doc_id", F.array_join("e.input", SEP).alias("input"),
                        F.array_join("e.target", SEP).alias("target"))

    return run


A = ("nl_tokens", "lang", "old_tokens", "new_tokens")

# --- masks -------------------------------------------------------------------------

query("span_noise_mask", f"WITH {TOKEN_PAIRS}, {mask_ctes('token_pairs', 'k', 'n', 0.3, 'e1')} "
                         "SELECT doc_id, k_m AS mask FROM k")(
    lambda spark, sf: typed(spark, sf).select("doc_id", F.array_join(F.transform(
        span_noise_mask(F.size("old_tokens"), 0.3, "e1", "doc_id"), lambda x: x.cast("string")), "")
        .alias("mask")))

# Every second token masked: more runs than there are sentinels.
query("collapse_masks", f"""WITH {TOKEN_PAIRS}, t AS (SELECT *, array_to_string(list_transform(a, lambda x, i:
        CASE WHEN {sql_draw('e2', 'doc_id', 'i')} < 0.5 THEN '1' ELSE '0' END), '') AS mk FROM token_pairs)
    SELECT doc_id, {sql_join(sql_collapse('a', "coalesce(mk, '')"), S)} AS out FROM t""")(
    lambda spark, sf: typed(spark, sf).select("doc_id", F.array_join(collapse_masks("old_tokens", F.transform(
        "old_tokens", lambda x, i: (X.draw("e2", "doc_id", i + 1) < 0.5).cast("int"))), SEP).alias("out")))

query("mask_message", f"""WITH {TOKEN_PAIRS}, {mask_ctes('token_pairs', 'k', 'len(nl)', 0.2, 'e3', True)}
    SELECT doc_id, {sql_join(sql_collapse('nl', 'k_m'), S)} AS out FROM k""")(
    lambda spark, sf: typed(spark, sf).select("doc_id", F.array_join(collapse_masks(
        "nl_tokens", message_mask(F.size("nl_tokens"), "e3", "doc_id")), SEP).alias("out")))


# --- objectives ----------------------------------------------------------------------

def keep_span_sql(seed: str, src: str = "token_pairs", tag: str = "") -> tuple[str, str]:
    """(CTEs, input expression) over ``<tag>n``."""
    ctes = (f"{mask_ctes(src, tag + 'c', '(p + s)', 0.3, seed)}, "
            f"{mask_ctes(tag + 'c', tag + 'n', 'len(nl)', 0.2, seed + '-nl', True)}")
    body = f"(substr({tag}c_m, 1, p) || repeat('0', dn) || substr({tag}c_m, p + 1))"
    return ctes, sql_collapse(framed("a"), f"('0' || {tag}n_m || '0' || {body})")


def target_sql(seed: str, src: str = "token_pairs", tag: str = "") -> tuple[str, str]:
    ctes = (f"{mask_ctes(src, tag + 'c', 'n', 0.2, seed + '-old', True)}, "
            f"{mask_ctes(tag + 'c', tag + 'n', 'len(nl)', 0.2, seed + '-nl', True)}")
    return ctes, sql_collapse(framed("a"), f"('0' || {tag}n_m || '0' || {tag}c_m)")


def corrupt_sql(seed: str, replace: bool = False, src: str = "token_pairs", name: str = "cor"
                ) -> tuple[str, str]:
    """(CTE ``name`` with the sentinel positions, input tokens)."""
    u = sql_draw(seed, "doc_id", "i")
    band = f"{u} >= 0.495" + ("" if replace else f" AND {u} < 0.71")
    cte = (f"{name} AS (SELECT *, list_filter(range(1, len(a) + 1), lambda i: {band})[1:99] AS hit "
           f"FROM {src})")
    rank = "list_position(hit, i)"
    sent = f"'<extra_id_' || ({rank} - 1) || '>'"
    kept = f"CASE WHEN {rank} IS NOT NULL THEN [{sent}] ELSE [x] END" if replace else "[x]"
    return cte, f"""flatten(list_transform(a, lambda x, i: CASE WHEN {u} < 0.495 THEN []::VARCHAR[]
        WHEN {u} < 0.71 THEN CASE WHEN {rank} IS NOT NULL THEN [{sent}, x] ELSE [x] END ELSE {kept} END))"""


_ctes, _inp = keep_span_sql("e4")
query("keep_span_example", f"WITH {TOKEN_PAIRS}, {_ctes} {both(_inp, 'b', 'n')}")(
    example(lambda: X.keep_span_example(*A, "ops", "e4", "doc_id", batched=True)))

# As published: the code keeps the length of its masked form but none of its masks.
_len = f"len({sql_collapse('a', chr(40) + 'substr(c_m, 1, p) || repeat(' + chr(39) + '0' + chr(39) + ', dn) || substr(c_m, p + 1)' + chr(41))})"
query("keep_span_example_compat", f"""WITH {TOKEN_PAIRS}, {_ctes}, x AS (SELECT *, a[1:{_len}] AS body FROM n)
    {both(sql_collapse(framed('body'), "('0' || n_m || '0' || repeat('0', len(body)))"), 'b', 'x')}""")(
    example(lambda: X.keep_span_example(*A, "ops", "e4", "doc_id", compat=True, batched=True)))

for _name, _replace in (("corrupted_example", False), ("corrupted_example_replace", True)):
    _cte, _body = corrupt_sql("e5", _replace)
    query(_name, f"""WITH {TOKEN_PAIRS}, {_cte}
        {both(framed(_body), "['<' || lang || '>'] || b", 'cor')}""")(
        example(lambda r=_replace: X.corrupted_example(*A, "e5", "doc_id", r, batched=True)))

_ctes6, _inp6 = target_sql("e6")
query("target_example", f"WITH {TOKEN_PAIRS}, {_ctes6} {both(_inp6, 'b', 'n')}")(
    example(lambda: X.target_example(*A, "e6", "doc_id")))

query("state_example", f"WITH {TOKEN_PAIRS} {both(framed('a'), 'b', 'token_pairs')}")(
    example(lambda: X.state_example(*A)))

_KW = ", ".join(f"'{k}'" for k in JAVA_KEYWORDS)
_IS_ID = f"(t NOT IN ({_KW}) AND regexp_matches(t, '\\A[\\p{{L}}_][\\p{{L}}\\p{{N}}_]*\\z'))"
query("identifier_example", f"""WITH {TOKEN_PAIRS}, t AS (SELECT *, list_filter(range(1, len(a) + 1),
        lambda i: {_IS_ID.replace('t NOT', 'a[i] NOT').replace('(t,', '(a[i],')})[1:99] AS hit FROM token_pairs)
    {both(framed('''list_transform(a, lambda x, i: CASE WHEN list_position(hit, i) IS NOT NULL
        THEN '<extra_id_' || (list_position(hit, i) - 1) || '>' ELSE x END)'''), "['<' || lang || '>'] || b", 't')}""")(
    example(lambda: X.identifier_example(*A)))

_U9 = sql_draw("e9", "doc_id", "i")
_LAB = "(i > p AND i <= n - s)"
query("edit_tag_example", f"""WITH {TOKEN_PAIRS}, t AS (SELECT *, list_filter(range(1, len(a) + 1), lambda i:
        {_U9} < CASE WHEN {_LAB} THEN 0.5 ELSE 0.2 END)[1:99] AS hit FROM token_pairs)
    {both(framed('''flatten(list_transform(a, lambda x, i: CASE WHEN list_position(hit, i) IS NOT NULL
        THEN ['<extra_id_' || (list_position(hit, i) - 1) || '>', x] ELSE [x] END))'''),
        f'''string_split(coalesce(array_to_string(list_transform(hit, lambda i, r: '<extra_id_' || (r - 1) || '>:' ||
            CASE WHEN {_LAB} THEN '<CHG>' ELSE '<KEEP>' END), ', '), ''), ' ')''', 't')}""")(
    example(lambda: X.edit_tag_example("nl_tokens", "lang", "old_tokens", "ops", "e9", "doc_id")))

_U10 = sql_draw("e10", "doc_id", "i")
_n10 = mask_ctes("token_pairs", "n", "len(nl)", 0.2, "e10-nl", True)
_m10 = (f"coalesce(array_to_string(list_transform(a, lambda x, i: CASE WHEN {_LAB} AND {_U10} < 0.5 "
        "THEN '1' ELSE '0' END), ''), '')")
query("edit_content_example", f"""WITH {TOKEN_PAIRS}, {_n10}, x AS (SELECT *, {_m10} AS am FROM n)
    {both(sql_collapse(framed('a'), "('0' || n_m || '0' || am)"), 'b', 'x')}""")(
    example(lambda: X.edit_content_example(*A, "ops", "e10", "doc_id", batched=True)))

_first_stay = f"list_position(list_transform(range(1, dn + 1), lambda i: {_U10} >= 0.5), true)"
query("edit_content_example_compat", f"""WITH {TOKEN_PAIRS}, {_n10}, x AS (SELECT *,
        coalesce({_first_stay} - 1, dn) AS hit FROM n)
    {both(sql_collapse(framed('a'), "('0' || n_m || '0' || repeat('0', p) || repeat('1', hit) || repeat('0', n - p - hit))"),
          'b', 'x')}""")(
    example(lambda: X.edit_content_example(*A, "ops", "e10", "doc_id", compat=True, batched=True)))

_PLAN = """(CASE mid WHEN 'replace' THEN ['<REPLACE_OLD>'] || gone || ['<REPLACE_NEW>'] || came || ['<REPLACE_END>']
    WHEN 'insert' THEN ['<INSERT>'] || came || ['<INSERT_END>']
    WHEN 'delete' THEN ['<DELETE>'] || gone || ['<DELETE_END>'] ELSE []::VARCHAR[] END)"""
query("edit_plan_example", f"WITH {TOKEN_PAIRS} {both(framed('a'), f'b || [{chr(39)}<s>{chr(39)}] || {_PLAN}', 'token_pairs')}")(
    example(lambda: X.edit_plan_example(*A, "ops")))
query("change_to_message_example", f"""WITH {TOKEN_PAIRS} {both(
    "['<' || lang || '>'] || a[1:250] || ['<s>'] || b[1:250]", "['<msg>'] || nl", 'token_pairs')}""")(
    example(lambda: X.change_to_message_example(*A)))
query("plan_to_message_example", f"WITH {TOKEN_PAIRS} {both(_PLAN, chr(91) + chr(39) + '<msg>' + chr(39) + '] || nl', 'token_pairs')}")(
    example(lambda: X.plan_to_message_example("nl_tokens", "old_tokens", "new_tokens", "ops")))

# --- mixture ---------------------------------------------------------------------------

SQL_OBJECTIVE = f"""(CASE WHEN {SQL_TYPE} = '{STATE_TYPE}' THEN '<dif>'
    WHEN {sql_draw('mix-1', 'doc_id')} < 0.33 THEN '<ksm>'
    WHEN {sql_draw('mix-2', 'doc_id')} < 0.66 THEN '<ade>' ELSE '<etg>' END)"""

query("assign_objective", f"""WITH {TOKEN_PAIRS} SELECT {SQL_TYPE} AS "type", {SQL_OBJECTIVE} AS objective,
    count(*) AS n FROM token_pairs GROUP BY ALL""")(
    lambda spark, sf: typed(spark, sf).groupBy("type", X.objective("type", "mix", "doc_id").alias("objective"))
    .agg(F.count("*").alias("n")))

_c1, _i1 = keep_span_sql("mix-ksm", "kept", "k")
_c2, _i2 = target_sql("mix-etg", "kept", "t")
_c3, _i3 = corrupt_sql("mix-ade", src="kept")
query("build_examples", f"""WITH {TOKEN_PAIRS}, kept AS (SELECT *, {SQL_OBJECTIVE} AS objective FROM token_pairs
        WHERE {SQL_TYPE} = '{STATE_TYPE}' OR len(nl) > 0), {_c1}, {_c2}, {_c3},
    e AS (SELECT doc_id, objective, {_i1} AS i, b AS t FROM kn WHERE objective = '<ksm>' UNION ALL
        SELECT doc_id, objective, {_i2}, b FROM tn WHERE objective = '<etg>' UNION ALL
        SELECT doc_id, objective, {framed(_i3)}, ['<' || lang || '>'] || b FROM cor WHERE objective = '<ade>' UNION ALL
        SELECT doc_id, objective, {framed('a')}, b FROM kept WHERE objective = '<dif>')
    SELECT doc_id, objective, array_to_string([objective] || i, {S}) AS input,
        array_to_string(['<updated_code>'] || t, {S}) AS target FROM e""")(
    lambda spark, sf: X.build_examples(typed(spark, sf), "doc_id").select(
        "doc_id", "objective", F.array_join("input", SEP).alias("input"),
        F.array_join("target", SEP).alias("target")))
