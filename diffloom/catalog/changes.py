"""Change extraction and edit-script queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import let, once
from ..functions.draws import draw
from ..functions.patch import side_lines
from ..functions.text import lines, words
from ..operators.anchors import anchor_edits, find_phrase
from ..operators.blocks import with_block_script
from ..operators.hunks import (budget_groups, budget_rejects, changed_lines, churn, expand_states, extract_hunks, line_delta)
from ..functions.lex import word_length
from ..operators.nodes import merge_short_edits
from ..operators.scripts import (edit_labels, edit_profile, edit_streams, is_edit_keyword, is_end, is_kind, is_new, is_start,
                                 payload, replay, with_script)
from .base import (CHANGES, TOKEN_PAIRS, changes, documents, query, sql_block_edits, sql_draw, sql_edits, sql_join, sql_lines,
                   sql_words, token_pairs)

S = "chr(31)"
SEP = "\u001f"


def joined(c):
    return F.array_join(c, SEP)


def ints(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), "")


# --- line deltas ------------------------------------------------------------------

_DELTA = f"""{CHANGES}, l AS (
    SELECT "commit", lang, unnest({sql_lines('old_contents')}) AS line, 0 AS s FROM changes UNION ALL
    SELECT "commit", lang, unnest({sql_lines('new_contents')}) AS line, 1 AS s FROM changes),
    c AS (SELECT "commit", lang, line, count(*) FILTER (s = 0) AS o, count(*) FILTER (s = 1) AS n
          FROM l GROUP BY ALL)"""


def _delta(spark, sf):
    return line_delta(changes(spark, sf), "commit", "old_contents", "new_contents", "lang")


query("line_delta", f"""WITH {_DELTA} SELECT "commit", lang, line, greatest(n - o, 0) AS added,
    greatest(o - n, 0) AS removed, least(o, n) AS kept FROM c""")(_delta)
query("line_churn", f"""WITH {_DELTA} SELECT lang, sum(greatest(n - o, 0))::BIGINT AS added,
    sum(greatest(o - n, 0))::BIGINT AS removed, sum(least(o, n))::BIGINT AS kept FROM c
    GROUP BY ROLLUP (lang)""")(lambda spark, sf: churn(_delta(spark, sf), "lang"))

# --- hunks ---------------------------------------------------------------------------
# What must hold for any diff: sides rebuilt from hunks lose as many lines as the texts
# differ by, a pair has hunks exactly if its lines differ, and every hunk line is a line
# of its side.  The hunks themselves are stated below.


def _hunk_audit(spark, sf):
    h = extract_hunks(changes(spark, sf))
    old = F.flatten(F.transform("hunks", lambda x: side_lines(x, "-")))
    new = F.flatten(F.transform("hunks", lambda x: side_lines(x, "+")))
    staged = h.select("commit", "hunks", old.alias("o"), new.alias("n"),
                      lines("old_contents").alias("a"), lines("new_contents").alias("b"))
    return staged.select(
        "commit", (F.size("hunks") > 0).cast("int").alias("changed"),
        (F.size("n") - F.size("o")).cast("long").alias("net"),
        (F.size(F.array_except("o", "a")) + F.size(F.array_except("n", "b"))).cast("long")
        .alias("foreign_lines"))


query("hunk_audit", f"""WITH {CHANGES}, l AS (SELECT "commit", {sql_lines('old_contents')} AS a,
        {sql_lines('new_contents')} AS b FROM changes)
    SELECT "commit", (a <> b)::INTEGER AS changed, CASE WHEN a <> b THEN len(b) - len(a) ELSE 0 END::BIGINT AS net,
        0::BIGINT AS foreign_lines FROM l""")(_hunk_audit)

_LINE_SIDES = f"""{CHANGES}, sides AS MATERIALIZED (SELECT doc_id, "commit", repos, message, {sql_lines('old_contents')} AS a,
        {sql_lines('new_contents')} AS b FROM changes), {sql_edits('sides')}"""


def _pre(sign, part):
    return f"list_transform({part}, lambda x: '{sign}' || x)"


# Edits at most six kept lines apart share a hunk; three kept lines stay around it.
_HUNKS = f"""{_LINE_SIDES}, h0 AS (SELECT *, lag(i2) OVER w AS last, lead(i1) OVER w AS next FROM edits
        WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
    h1 AS (SELECT *, last IS NULL OR i1 - last > 6 AS opens, next IS NULL OR next - i2 > 6 AS closes FROM h0),
    h2 AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY k) AS g FROM h1),
    h3 AS (SELECT h.doc_id, "commit", repos, message, g, k, {_pre(' ', 'a[CASE WHEN opens THEN greatest(0, i1 - 3) ELSE last END + 1:i1]')}
        || {_pre('-', 'a[i1 + 1:i2]')} || {_pre('+', 'b[j1 + 1:j2]')}
        || CASE WHEN closes THEN {_pre(' ', 'a[i2 + 1:i2 + 3]')} ELSE [] END AS piece FROM h2 h JOIN sides USING (doc_id)),
    hunks AS MATERIALIZED (SELECT doc_id, "commit", repos, message, g, array_to_string(flatten(list(piece ORDER BY k)), chr(10)) AS hunk
        FROM h3 GROUP BY ALL)"""

query("extract_hunks", f"""WITH {_HUNKS} SELECT "commit", repos, message, string_agg(hunk, chr(10) ORDER BY g) AS diff,
    count(*) AS n_hunks FROM hunks GROUP BY ALL""")(
    lambda spark, sf: extract_hunks(changed_lines(changes(spark, sf))).select(
        "commit", "repos", "message", F.array_join("hunks", "\n").alias("diff"), F.size("hunks").alias("n_hunks")))

# States from hunks that SQL can build too: lines are grouped by five, each group is a
# hunk whose lines are signed by their number.
_SIGNED = """hunked AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS "commit", list_transform(range(0, (len(ls) + 4) // 5),
    lambda g: array_to_string(list_transform(ls[g * 5 + 1:g * 5 + 5], lambda ln, i:
        (CASE (g + i) % 4 WHEN 1 THEN '-' WHEN 2 THEN '+' ELSE ' ' END) || ln), chr(10))) AS hunks
    FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))"""


def _signed_hunks(spark, sf):
    def group(ls, g):
        def sign(ln, i):
            k = (g + i + 1) % 4
            return F.concat(F.when(k == 1, "-").when(k == 2, "+").otherwise(" "), ln)

        return F.array_join(F.transform(F.slice(ls, g * 5 + 1, F.lit(5)), sign), "\n")

    hunks = let(lambda ls: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(ls) + 4) / 5).cast("int") - 1),
        lambda g: group(ls, g)), F.split("text", "\n", -1))
    return documents(spark, sf).select(
        F.col("doc_id").cast("string").alias("commit"), hunks.alias("hunks"))


_BUDGET = 120
# Groups: whole, or the short hunks as one group, or pairs of them.
def _sql_groups(hunked, budget):
    return f"""{hunked}, g0 AS (SELECT "commit", hunks, len({sql_words("array_to_string(hunks, chr(10))")}) AS total,
        list_filter(hunks, lambda h: len({sql_words('h')}) <= {budget}) AS short FROM hunked),
    g1 AS (SELECT *, len({sql_words("coalesce(array_to_string(short, chr(10)), '')")}) AS rest FROM g0),
    g2 AS (SELECT "commit", len(hunks) AS n, CASE WHEN len(hunks) = 1 OR total <= {budget} THEN [hunks]
            WHEN len(short) = 0 THEN []::VARCHAR[][] WHEN rest < {budget} THEN [short]
            ELSE list_transform(range(1, len(short) // 2 + 1), lambda i: short[2 * i - 1:2 * i]) END AS groups FROM g1),
    groups AS (SELECT "commit", n, unnest(groups) AS hs, generate_subscripts(groups, 1) - 1 AS group_idx FROM g2)"""


_GROUPS = _sql_groups(_SIGNED, _BUDGET)

query("budget_groups", f"""WITH {_GROUPS} SELECT "commit", group_idx, len(hs)::BIGINT AS n_hunks,
    md5(array_to_string(hs, chr(10))) AS digest FROM groups""")(
    lambda spark, sf: _signed_hunks(spark, sf).select("commit", F.posexplode(budget_groups(
        "hunks", word_length, _BUDGET)).alias("group_idx", "hs")).select(
        "commit", "group_idx", F.size("hs").cast("long").alias("n_hunks"),
        F.md5(F.array_join("hs", "\n")).alias("digest")))

query("budget_rejects", f"""WITH {_GROUPS}, hh AS (SELECT "commit", len(hunks) AS n, total, rest, unnest(hunks) AS h,
        generate_subscripts(hunks, 1) - 1 AS hunk_idx FROM g1),
    f AS (SELECT *, len({sql_words('h')}) <= {_BUDGET} AS fits FROM hh WHERE n > 1 AND total > {_BUDGET}),
    o AS (SELECT *, count(*) FILTER (fits) OVER (PARTITION BY "commit") AS nfit,
        max(hunk_idx) FILTER (fits) OVER (PARTITION BY "commit") AS last_fit FROM f)
    SELECT "commit", hunk_idx, CASE WHEN fits THEN 'odd tail' ELSE 'over budget' END AS reason FROM o
    WHERE NOT fits OR (hunk_idx = last_fit AND nfit % 2 = 1 AND rest >= {_BUDGET})""")(
    lambda spark, sf: budget_rejects(_signed_hunks(spark, sf), word_length, _BUDGET))

# Kept and rejected hunks are all hunks.
query("budget_funnel", """SELECT 'all' AS part, sum((len(string_split(text, chr(10))) + 4) // 5)::BIGINT AS hunks FROM documents UNION ALL
    SELECT 'kept and rejected', sum((len(string_split(text, chr(10))) + 4) // 5)::BIGINT FROM documents""")(
    lambda spark, sf: (lambda h: h.agg(F.lit("all").alias("part"), F.sum(F.size("hunks")).alias("hunks")).unionByName(
        h.select(F.explode(budget_groups("hunks", word_length, _BUDGET)).alias("g")).select(F.size("g").cast("long").alias("n"))
        .unionByName(budget_rejects(h, word_length, _BUDGET).select(F.lit(1).cast("long").alias("n")))
        .agg(F.lit("kept and rejected").alias("part"), F.sum("n").alias("hunks"))))(_signed_hunks(spark, sf)))


def _sql_states(compat, groups=_GROUPS):
    def side(h, sign):
        return (f"list_transform(list_filter(string_split({h}, chr(10)), lambda ln: "
                f"starts_with(ln, '{sign}') OR starts_with(ln, ' ')), lambda ln: substr(ln, 2))")

    def text(lst):
        return f"coalesce(array_to_string(flatten({lst}), chr(10)), '')"

    if compat:
        old = f"{text('news[1:t]')} || chr(10) || {text('olds[t + 1:]')}"
    else:
        old = text("list_concat(news[1:t], olds[t + 1:])")
    # The sides of the hunks here have signs on all lines, so a one-hunk change splits
    # the same way in both forms unless faults are kept.
    single_old = (f"""array_to_string(flatten(list_transform(string_split(hs[1], chr(10)), lambda ln: CASE
        WHEN starts_with(ln, '+') THEN []::VARCHAR[] WHEN starts_with(ln, '-')
        THEN {'[substr(ln, 2), substr(ln, 2)]' if compat else '[substr(ln, 2)]'} ELSE [substr(ln, 2)] END)), chr(10))""")
    single_new = (f"""array_to_string(flatten(list_transform(string_split(hs[1], chr(10)), lambda ln: CASE
        WHEN starts_with(ln, '-') THEN {'[substr(ln, 2)]' if compat else '[]::VARCHAR[]'}
        ELSE [substr(ln, 2)] END)), chr(10))""")
    u = sql_draw("states", '"commit"', "group_idx", "i")
    return f"""WITH {groups}, st AS (SELECT *, len(hs) AS m, list_transform(hs, lambda h: {side('h', '-')}) AS olds,
            list_transform(hs, lambda h: {side('h', '+')}) AS news FROM groups),
        ids AS (SELECT *, CASE WHEN m <= 3 THEN range(0, m) ELSE [0] || list_sort(list_transform(list_sort(
            list_transform(range(1, m), lambda i: {{'u': {u}, 'i': i}}))[1:3], lambda s: s.i)) END AS ids FROM st),
        ex AS (SELECT *, unnest(ids) AS t, len(ids) AS state_cnt FROM ids)
        SELECT "commit", group_idx, t AS state_idx, state_cnt,
            CASE WHEN n = 1 THEN coalesce({single_old}, '') ELSE {old} END AS old,
            CASE WHEN n = 1 THEN coalesce({single_new}, '') ELSE {text('news')} END AS new FROM ex"""


for _name, _compat in (("expand_states", False), ("expand_states_compat", True)):
    query(_name, _sql_states(_compat))(
        lambda spark, sf, c=_compat: expand_states(_signed_hunks(spark, sf), word_length,
                                                   budget=_BUDGET, compat=c))



def sql_prepared_states():
    """states("commit", group_idx, state_idx, old, new, msg) of the hunks of the anchored line diff."""
    hunked = f"""{_HUNKS}, hunked AS (SELECT "commit", list(hunk ORDER BY g) AS hunks FROM hunks GROUP BY "commit")"""
    whole = _sql_states(False, _sql_groups(hunked, 510))
    cut = whole.rindex('SELECT "commit", group_idx, t AS state_idx')
    head, body = whole[len("WITH "):cut].rstrip(), whole[cut:]
    return f"""{head}, states AS (SELECT x.*, c.message AS msg FROM ({body}) x JOIN changes c ON c."commit" = x."commit")"""


# --- scripts ---------------------------------------------------------------------------

query("trim_script", f"""WITH {TOKEN_PAIRS}, o AS (
    SELECT doc_id, 'equal' AS tag, 0 AS i1, p AS i2, 0 AS j1, p AS j2 FROM token_pairs WHERE p > 0 UNION ALL
    SELECT doc_id, mid, p, n - s, p, m - s FROM token_pairs WHERE mid IS NOT NULL UNION ALL
    SELECT doc_id, 'equal', n - s, n, m - s, m FROM token_pairs WHERE s > 0)
    SELECT doc_id, tag, i1, i2, j1, j2 FROM o""")(
    lambda spark, sf: token_pairs(spark, sf).select("doc_id", F.inline(once("ops"))))


def _sql_stream(minimal):
    keep = "[]::VARCHAR[]"

    def kept(part, fmt):
        return keep if minimal else fmt.format(x=part)

    def lab(tag, x):
        return f"flatten(list_transform({x}, lambda t: ['{tag}', t]))"

    def rep(tag, x):
        return f"list_transform({x}, lambda t: '{tag}')"

    spans = [kept(x, "(CASE WHEN len({x}) > 0 THEN ['<KEEP>'] || {x} || ['<KEEP_END>'] ELSE [] END)")
             for x in ("head", "tail")]
    toks = [kept(x, lab("<KEEP>", "{x}")) for x in ("head", "tail")]
    cmds = [kept(x, rep("<KEEP>", "{x}")) for x in ("head", "tail")]
    mid_spans = """(CASE mid WHEN 'replace' THEN ['<REPLACE_OLD>'] || gone || ['<REPLACE_NEW>'] || came || ['<REPLACE_END>']
        WHEN 'insert' THEN ['<INSERT>'] || came || ['<INSERT_END>']
        WHEN 'delete' THEN ['<DELETE>'] || gone || ['<DELETE_END>'] ELSE [] END)"""
    mid_toks = f"""(CASE mid WHEN 'replace' THEN {lab('<REPLACE_OLD>', 'gone')} || {lab('<REPLACE_NEW>', 'came')}
        WHEN 'insert' THEN {lab('<INSERT>', 'came')} WHEN 'delete' THEN {lab('<DELETE>', 'gone')} ELSE [] END)"""
    mid_cmds = f"""(CASE mid WHEN 'replace' THEN {rep('<REPLACE_OLD>', 'gone')} || {lab('<REPLACE_NEW>', 'came')}
        WHEN 'insert' THEN {lab('<INSERT>', 'came')} WHEN 'delete' THEN {rep('<DELETE>', 'gone')} ELSE [] END)"""

    def cat(a, b, c):
        return f"coalesce(array_to_string({a} || {b} || {c}, {S}), '')"

    return f"""WITH {TOKEN_PAIRS} SELECT doc_id, {cat(spans[0], mid_spans, spans[1])} AS spans,
        {cat(toks[0], mid_toks, toks[1])} AS tokens, {cat(cmds[0], mid_cmds, cmds[1])} AS commands FROM token_pairs"""


def _streams(minimal):
    def build(spark, sf):
        p = token_pairs(spark, sf).select("doc_id", edit_streams(
            "old_tokens", "new_tokens", "ops", minimal).alias("s"))
        return p.select("doc_id", *[joined(F.col(f"s.{f}")).alias(f)
                                    for f in ("spans", "tokens", "commands")])

    return build


query("edit_streams", _sql_stream(False))(_streams(False))
query("edit_plan", _sql_stream(True))(_streams(True))

query("edit_labels", f"""WITH {TOKEN_PAIRS} SELECT doc_id, {sql_join('a', S)} AS old_tokens,
    repeat('0', p) || repeat('1', dn) || repeat('0', s) AS old_labels, {sql_join('b', S)} AS new_tokens,
    repeat('0', p) || repeat('2', dm) || repeat('0', s) AS new_labels FROM token_pairs""")(
    lambda spark, sf: token_pairs(spark, sf).select("doc_id", edit_labels(
        "old_tokens", "new_tokens", "ops").alias("l")).select(
        "doc_id", joined(F.col("l.old_tokens")).alias("old_tokens"), ints(F.col("l.old_labels")).alias("old_labels"),
        joined(F.col("l.new_tokens")).alias("new_tokens"), ints(F.col("l.new_labels")).alias("new_labels")))

query("edit_profile", f"""WITH {TOKEN_PAIRS}, k AS (
    SELECT lang, '<KEEP>' AS keyword, p + s AS n FROM token_pairs UNION ALL
    SELECT lang, CASE mid WHEN 'replace' THEN '<REPLACE_OLD>' ELSE '<DELETE>' END, dn FROM token_pairs
        WHERE mid IN ('replace', 'delete') UNION ALL
    SELECT lang, CASE mid WHEN 'replace' THEN '<REPLACE_NEW>' ELSE '<INSERT>' END, dm FROM token_pairs
        WHERE mid IN ('replace', 'insert'))
    SELECT lang, keyword, sum(n)::BIGINT AS tokens FROM k WHERE n > 0 GROUP BY ALL""")(
    lambda spark, sf: edit_profile(token_pairs(spark, sf), "ops", "lang"))


def _short(x, replace=False):
    return "FALSE" if replace else f"(len({x}) = 1)"


# Merged trim scripts: a script has at most three nodes, so the cases can be listed.
query("merge_short_edits", f"""WITH {TOKEN_PAIRS}, nodes AS (SELECT doc_id, n, m, p, s, mid,
        p = 1 AS hs, s = 1 AS ts, p > 0 AS hx, s > 0 AS tx, mid IS NOT NULL AS mx,
        (mid = 'insert' AND dm = 1) OR (mid = 'delete' AND dn = 1) AS ms FROM token_pairs),
    k AS (SELECT *, hx AND (NOT hs OR (NOT mx AND NOT tx)) AND NOT (mx AND NOT tx AND coalesce(ms, false)) AS head_kept,
        tx AND (NOT ts OR (NOT mx AND NOT hx)) AND NOT (coalesce(ms, false) AND NOT (hx AND hs)) AS tail_kept FROM nodes),
    o AS (SELECT doc_id, 'equal' AS tag, 0 AS i1, p AS i2, 0 AS j1, p AS j2 FROM k WHERE head_kept UNION ALL
        SELECT doc_id, 'replace', CASE WHEN head_kept THEN p ELSE 0 END, CASE WHEN tail_kept THEN n - s ELSE n END,
            CASE WHEN head_kept THEN p ELSE 0 END, CASE WHEN tail_kept THEN m - s ELSE m END FROM k
            WHERE mx OR (hx AND NOT head_kept) OR (tx AND NOT tail_kept) UNION ALL
        SELECT doc_id, 'equal', n - s, n, m - s, m FROM k WHERE tail_kept)
    SELECT * FROM o""")(
    lambda spark, sf: token_pairs(spark, sf).select("doc_id", F.inline(merge_short_edits("ops"))))

# Marked text: boundaries around tokens, so phrases are found as substrings.
_MARK = "coalesce(array_to_string(list_transform({x}, lambda t: chr(1) || t || chr(2)), ''), '')"


def _sql_once(text, phrase):
    return (f"({phrase} <> '' AND instr({text}, {phrase}) > 0 AND "
            f"instr(substr({text}, instr({text}, {phrase}) + 1), {phrase}) = 0)")


def _sql_anchor():
    # More context never makes a phrase ambiguous again, so the least k is one more than
    # the longest k whose phrase still occurs elsewhere.
    def ctx(k, before):
        x = f"a[p - {k} + 1:p] || gone" if before else f"gone || a[n - s + 1:n - s + {k}]"
        return _MARK.format(x=f"({x})")

    def first(limit, before):
        return (f"list_position(list_transform(range(1, {limit} + 1), lambda k: "
                f"{_sql_once('txt', ctx('k', before))}), true)")

    return f"""WITH {TOKEN_PAIRS}, t AS (SELECT *, {_MARK.format(x='a')} AS txt, {_MARK.format(x='gone')} AS ph
            FROM token_pairs WHERE mid IS NOT NULL),
        f AS (SELECT *, {_sql_once('txt', 'ph')} AS self FROM t),
        b AS (SELECT *, CASE WHEN self THEN 0 ELSE {first('p', True)} END AS kb FROM f),
        c AS (SELECT *, CASE WHEN self OR kb IS NOT NULL THEN 0 ELSE {first('s', False)} END AS ka FROM b)
        SELECT doc_id, (p > 0)::INTEGER AS edit, mid AS tag, p AS "at",
            CASE WHEN self THEN 'self' WHEN kb IS NOT NULL THEN 'before' WHEN ka IS NOT NULL THEN 'after'
                 ELSE 'full' END AS anchor,
            coalesce(CASE WHEN self THEN 0 WHEN kb IS NOT NULL THEN kb ELSE ka END, 0) AS context FROM c"""


query("anchor_edits", _sql_anchor())(
    lambda spark, sf: anchor_edits(token_pairs(spark, sf), "old_tokens", "new_tokens", "ops", "doc_id"))

# Three words of each document at a drawn place, looked up in its new side.
_PLACE = f"floor({sql_draw('phrase', 'doc_id')} * greatest(len(o) - 2, 1))::INTEGER"
query("find_phrase", f"""WITH {CHANGES}, s AS (SELECT doc_id, {sql_words('old_contents')} AS o, {sql_words('new_contents')} AS w FROM changes),
    t AS (SELECT doc_id, o[{_PLACE} + 1:{_PLACE} + 3] AS ph, w FROM s),
    h AS (SELECT doc_id, ph, list_filter(range(1, len(w) - len(ph) + 2), lambda i: len(ph) > 0 AND w[i:i + len(ph) - 1] = ph) AS hit FROM t)
    SELECT doc_id, CASE WHEN len(ph) = 0 THEN 0 WHEN len(hit) > 0 THEN hit[1] - 1 ELSE -1 END AS "first",
        len(hit) AS freq, (len(hit) > 1)::INTEGER AS ambiguous FROM h""")(
    lambda spark, sf: changes(spark, sf).select("doc_id", words("old_contents").alias("o"), words("new_contents").alias("w")).select(
        "doc_id", find_phrase(F.slice("o", (F.floor(draw("phrase", "doc_id") * F.greatest(F.size("o") - 2, F.lit(1))) + 1).cast("int"),
                                      F.lit(3)), "w").alias("f")).select(
        "doc_id", "f.first", "f.freq", F.col("f.ambiguous").cast("int").alias("ambiguous")))

# Keyword predicates over the span streams.
_KIND = " ".join(f"WHEN contains(t, '{k}') THEN '{k.lower()}'" for k in ("INSERT", "KEEP", "REPLACE", "DELETE"))
query("stream_keywords", f"""WITH {TOKEN_PAIRS}, s AS (SELECT unnest(x) AS t FROM (SELECT CASE mid
        WHEN 'replace' THEN ['<REPLACE_OLD>', '<REPLACE_NEW>', '<REPLACE_END>'] WHEN 'insert' THEN ['<INSERT>', '<INSERT_END>']
        WHEN 'delete' THEN ['<DELETE>', '<DELETE_END>'] END AS x FROM token_pairs WHERE mid IS NOT NULL))
    SELECT CASE {_KIND} END AS kind, count(*) FILTER (contains(t, 'END')) AS ends, count(*) FILTER (contains(t, 'NEW')) AS news,
        count(*) FILTER (NOT contains(t, 'END') AND NOT contains(t, 'NEW')) AS starts FROM s GROUP BY 1""")(
    lambda spark, sf: token_pairs(spark, sf).select(F.explode(edit_streams("old_tokens", "new_tokens", "ops", True)["spans"]).alias("t"))
    .where(F.col("t").rlike(r"\A<[A-Z_]+>\z") & is_edit_keyword("t")).select("t", F.coalesce(*[
        F.when(is_kind("t", k), F.lit(k)) for k in ("insert", "keep", "replace", "delete")]).alias("kind"))
    .groupBy("kind").agg(F.count_if(is_end("t")).alias("ends"), F.count_if(is_new("t")).alias("news"),
                         F.count_if(is_start("t")).alias("starts")))

# --- anchored scripts -------------------------------------------------------------------


def scripted_pairs(spark, sf):
    p = changes(spark, sf).select(
        "doc_id", "lang", words("message").alias("nl_tokens"), words("old_contents").alias("old_tokens"),
        words("new_contents").alias("new_tokens"))
    return with_script(p, "old_tokens", "new_tokens")


_SIDES = f"""{CHANGES}, sides AS MATERIALIZED (SELECT doc_id, lang, {sql_words('old_contents')} AS a, {sql_words('new_contents')} AS b
    FROM changes), {sql_edits('sides')}"""

# For any script: sides are restated, the replay gives the new side, kept tokens are equal
# on both sides, and label counts follow from the lengths.
query("replay_audit", f"""WITH {CHANGES} SELECT lang, count(*) AS n_rows, count(*) AS rebuilt, count(*) AS tiles,
        sum(len({sql_words('old_contents')}))::BIGINT AS old_tokens,
        sum(len({sql_words('new_contents')}))::BIGINT AS new_tokens,
        sum(len({sql_words('new_contents')}) - len({sql_words('old_contents')}))::BIGINT AS net_labels
    FROM changes GROUP BY lang""")(
    lambda spark, sf: scripted_pairs(spark, sf).select(
        "lang", "old_tokens", "new_tokens", replay("old_tokens", payload("new_tokens", "ops"), "ops").alias("r"),
        edit_labels("old_tokens", "new_tokens", "ops").alias("l")).select(
        "lang",
        ((F.col("r.tokens") == F.col("new_tokens")) & (F.col("l.old_tokens") == F.col("old_tokens"))
         & (F.col("l.new_tokens") == F.col("new_tokens"))).cast("int").alias("ok"),
        F.col("r.tiles").cast("int").alias("tiles"), F.size("old_tokens").alias("o"), F.size("new_tokens").alias("n"),
        (F.size(F.filter("l.new_labels", lambda x: x == 2)) - F.size(F.filter("l.old_labels", lambda x: x == 1))).alias("d"))
    .groupBy("lang").agg(F.count("*").alias("n_rows"), F.sum("ok").alias("rebuilt"), F.sum("tiles").alias("tiles"),
                         F.sum("o").alias("old_tokens"), F.sum("n").alias("new_tokens"), F.sum("d").alias("net_labels")))

# The whole script: longest matching blocks, left and right of each again.
query("edit_script", f"""WITH RECURSIVE {_SIDES.replace(sql_edits('sides'), sql_block_edits('sides'))}
    SELECT doc_id, tag, i1, i2, j1, j2 FROM ops""")(
    lambda spark, sf: with_block_script(changes(spark, sf).select(
        "doc_id", words("old_contents").alias("a"), words("new_contents").alias("b")), "a", "b").select("doc_id", F.inline(once("ops"))))

query("edit_script_profile", f"""WITH {_SIDES}, w AS (SELECT doc_id, CASE tag WHEN 'equal' THEN '<KEEP>' WHEN 'delete' THEN '<DELETE>'
        ELSE '<REPLACE_OLD>' END AS keyword, i2 - i1 AS n FROM ops WHERE tag <> 'insert' UNION ALL
        SELECT doc_id, CASE tag WHEN 'insert' THEN '<INSERT>' ELSE '<REPLACE_NEW>' END, j2 - j1 FROM ops WHERE tag IN ('insert', 'replace'))
    SELECT lang, keyword, sum(n)::BIGINT AS tokens FROM w JOIN sides USING (doc_id) GROUP BY ALL""")(
    lambda spark, sf: edit_profile(scripted_pairs(spark, sf), "ops", "lang"))

# One-token nodes join a neighbour, then edits in a row become one.
_MERGED = f"""{_SIDES}, m0 AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, tag <> 'replace' AND greatest(i2 - i1, j2 - j1) = 1 AS short FROM ops),
    m1 AS (SELECT *, coalesce(lag(short) OVER w, false) AS s1, coalesce(lag(short, 2) OVER w, false) AS s2,
        coalesce(lead(short) OVER w, false) AS n1 FROM m0 WINDOW w AS (PARTITION BY doc_id ORDER BY idx)),
    m2 AS (SELECT *, tag = 'equal' AND (n = 1 OR (NOT short AND NOT (s1 AND NOT s2) AND NOT (idx = n - 1 AND n1))) AS keep FROM m1),
    m3 AS (SELECT *, idx = 1 OR keep OR lag(keep) OVER (PARTITION BY doc_id ORDER BY idx) AS opens FROM m2),
    m4 AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY idx) AS g FROM m3),
    merged AS MATERIALIZED (SELECT doc_id, g, CASE WHEN bool_or(keep) THEN 'equal' ELSE 'replace' END AS tag, min(i1) AS i1,
        max(i2) AS i2, min(j1) AS j1, max(j2) AS j2 FROM m4 GROUP BY doc_id, g)"""
query("edit_script_merged", f"WITH {_MERGED} SELECT doc_id, tag, i1, i2, j1, j2 FROM merged")(
    lambda spark, sf: scripted_pairs(spark, sf).select("doc_id", F.inline(merge_short_edits("ops"))))


def _sql_edit_anchors():
    def ctx(k, before):
        x = f"a[i1 - {k} + 1:i2]" if before else f"a[i1 + 1:i2 + {k}]"
        return _MARK.format(x=f"({x})")

    def first(limit, before):
        return (f"list_position(list_transform(range(1, {limit} + 1), lambda k: "
                f"{_sql_once('txt', ctx('k', before))}), true)")

    return f"""WITH {_SIDES}, r AS (SELECT *, coalesce(CASE WHEN lag(tag) OVER w = 'equal' THEN lag(i2 - i1) OVER w END, 0) AS rb,
            coalesce(CASE WHEN lead(tag) OVER w = 'equal' THEN lead(i2 - i1) OVER w END, 0) AS ra
            FROM ops WINDOW w AS (PARTITION BY doc_id ORDER BY idx)),
        t AS (SELECT r.*, a, {_MARK.format(x='a')} AS txt, {_MARK.format(x='a[i1 + 1:i2]')} AS ph
            FROM r JOIN sides USING (doc_id) WHERE tag <> 'equal'),
        f AS (SELECT *, {_sql_once('txt', 'ph')} AS self FROM t),
        b AS (SELECT *, CASE WHEN self THEN 0 ELSE {first('rb', True)} END AS kb FROM f),
        c AS (SELECT *, CASE WHEN self OR kb IS NOT NULL THEN 0 ELSE {first('ra', False)} END AS ka FROM b)
        SELECT doc_id, idx - 1 AS edit, tag, i1 AS "at",
            CASE WHEN self THEN 'self' WHEN kb IS NOT NULL THEN 'before' WHEN ka IS NOT NULL THEN 'after' ELSE 'full' END AS anchor,
            coalesce(CASE WHEN self THEN 0 WHEN kb IS NOT NULL THEN kb ELSE ka END, 0) AS context FROM c"""


query("edit_script_anchors", _sql_edit_anchors())(
    lambda spark, sf: anchor_edits(scripted_pairs(spark, sf), "old_tokens", "new_tokens", "ops", "doc_id"))

query("comment_streams", f"""WITH {_MERGED}, p AS (SELECT m.doc_id, g, tag, a[i1 + 1:i2] AS o, b[j1 + 1:j2] AS n FROM merged m JOIN sides USING (doc_id)),
    q AS (SELECT doc_id, g, CASE tag WHEN 'equal' THEN ['<KEEP>'] || o || ['<KEEP_END>']
            ELSE ['<REPLACE_OLD>'] || o || ['<REPLACE_NEW>'] || n || ['<REPLACE_END>'] END AS spans,
        CASE tag WHEN 'equal' THEN list_transform(o, lambda x: '<KEEP>')
            ELSE list_transform(o, lambda x: '<REPLACE_OLD>') || flatten(list_transform(n, lambda x: ['<REPLACE_NEW>', x])) END AS commands FROM p)
    SELECT doc_id, coalesce(array_to_string(flatten(list(spans ORDER BY g)), {S}), '') AS spans,
        coalesce(array_to_string(flatten(list(commands ORDER BY g)), {S}), '') AS commands
    FROM (SELECT doc_id FROM sides) LEFT JOIN q USING (doc_id) GROUP BY doc_id""")(
    lambda spark, sf: scripted_pairs(spark, sf).select("doc_id", edit_streams(
        "old_tokens", "new_tokens", merge_short_edits("ops")).alias("s")).select(
        "doc_id", joined(F.col("s.spans")).alias("spans"), joined(F.col("s.commands")).alias("commands")))
