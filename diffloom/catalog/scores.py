"""Corpus score queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import let
from ..functions.text import words
from ..markers import C_SHARP_KEYWORDS, JAVA_KEYWORDS
from ..operators import scores as S
from ..operators.grams import document_frequency, gram_counts
from .base import (CONVERSATION_PAIRS, GRAMS, PREDICTIONS, conversation_pairs, documents, edited,
                   gold_words, pred_words, predictions, query, src_words, sql_brevity, sql_draw, sql_stats, sql_edited, sql_strip, sql_words, table)
from .text import sql_normalize

ORDERS = (1, 2, 3, 4)


def rounded(df, *cols, digits=6):
    return df.select(*[c for c in df.columns if c not in cols],
                     *[F.round(F.col(c), digits).alias(c) for c in cols])


def _geo(terms):
    return "exp((" + " + ".join(f"ln({t})" for t in terms) + ") / 4)"


# --- plus-one BLEU ------------------------------------------------------------

def sql_bleu(by: str = "", smooth: bool = True) -> str:
    """Score per slice from stats."""
    sums = ", ".join(f"sum(m{n})::DOUBLE AS m{n}, sum(h{n})::DOUBLE AS h{n}" for n in ORDERS)
    if smooth:
        geo = _geo(f"(m{n} + 1) / (h{n} + 1)" for n in ORDERS)
    else:
        geo = ("CASE WHEN least(m1, m2, m3, m4) > 0 THEN "
               + _geo(f"m{n} / h{n}" for n in ORDERS) + " ELSE 0 END")
    sel, grp = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    return f"""SELECT {sel}round({geo} * {sql_brevity('rl', 'hl')}, 6) AS bleu FROM (
        SELECT {sel}{sums}, sum(hyp_len)::BIGINT AS hl, sum(ref_len)::BIGINT AS rl FROM stats {grp})"""


query("corpus_bleu_by_lang", f"WITH {GRAMS}, {sql_stats()} {sql_bleu('lang')}")(
    lambda spark, sf: rounded(S.corpus_bleu(predictions(spark, sf), "row_id", pred_words(), gold_words(), "lang"),
                              "bleu").select("lang", "bleu"))
query("corpus_bleu", f"WITH {GRAMS}, {sql_stats()} {sql_bleu()}")(
    lambda spark, sf: rounded(S.corpus_bleu(predictions(spark, sf), "row_id", pred_words(), gold_words()),
                              "bleu").select("bleu"))
query("corpus_bleu_unsmoothed", f"WITH {GRAMS}, {sql_stats()} {sql_bleu(smooth=False)}")(
    lambda spark, sf: rounded(S.corpus_bleu(predictions(spark, sf), "row_id", pred_words(), gold_words(),
                                            smooth=False), "bleu").select("bleu"))

# The same over conversation turns: what a score looks like with little overlap.
CONV_GRAMS = (CONVERSATION_PAIRS + f""", predictions AS MATERIALIZED (
    SELECT row_id, role AS lang, {sql_words('pred')} AS pred, {sql_words('gold')} AS gold,
           []::VARCHAR[] AS source FROM conversation_pairs)""" + GRAMS[len(PREDICTIONS):])
query("conversation_bleu_by_role", f"""WITH {CONV_GRAMS}, {sql_stats()}
    SELECT lang AS role, bleu FROM ({sql_bleu('lang')})""")(
    lambda spark, sf: rounded(S.corpus_bleu(conversation_pairs(spark, sf), "row_id", words("pred"),
                                            words("gold"), "role"), "bleu").select("role", "bleu"))
query("line_bleu", f"""WITH {CONV_GRAMS}, {sql_stats()}
    SELECT round(100 * bleu, 2) AS bleu FROM ({sql_bleu().replace(', 6) AS', ', 12) AS')})""")(
    lambda spark, sf: S.file_bleu(conversation_pairs(spark, sf), "row_id", "pred", "gold"))


# --- exact match and accuracy ---------------------------------------------------

def _turn():
    return F.substring_index("row_id", "-", -1).cast("long")


query("exact_match", f"""WITH {CONVERSATION_PAIRS}, p AS (SELECT role, pred, CASE WHEN split_part(row_id, '-', 2)::BIGINT % 3 = 0
        THEN ' ' || pred || chr(10) ELSE gold END AS gold FROM conversation_pairs)
    SELECT role, round(100 * avg(CASE WHEN {sql_strip('pred')} = {sql_strip('gold')}
        THEN 1.0::DOUBLE ELSE 0 END), 6) AS em, count(*) AS n_rows FROM p GROUP BY role""")(
    lambda spark, sf: rounded(S.exact_match(conversation_pairs(spark, sf).withColumn(
        "gold", F.when(_turn() % 3 == 0, F.concat(F.lit(" "), "pred", F.lit("\n")))
        .otherwise(F.col("gold"))), "pred", "gold", "role"), "em"))

_NOISY = """CASE WHEN split_part(row_id, '-', 2)::BIGINT % 2 = 0 THEN upper(substr(pred, 1, 1)) || substr(pred, 2) || ' !'
    ELSE gold END"""


def _noisy(spark, sf):
    p = conversation_pairs(spark, sf)
    loud = F.concat(F.upper(F.substring("pred", 1, 1)), F.substring("pred", 2, 2**31 - 1), F.lit(" !"))
    return p.withColumn("gold", F.when(_turn() % 2 == 0, loud).otherwise(F.col("gold")))


query("normalized_accuracy", f"""WITH {CONVERSATION_PAIRS}, p AS (
        SELECT role, pred, {_NOISY} AS gold FROM conversation_pairs)
    SELECT role, round(100 * avg(CASE WHEN {sql_normalize('pred')} = {sql_normalize('gold')}
        THEN 1.0::DOUBLE ELSE 0 END), 6) AS acc FROM p GROUP BY role""")(
    lambda spark, sf: rounded(S.normalized_accuracy(_noisy(spark, sf), "pred", "gold", "role"), "acc"))

# --- epsilon BLEU -----------------------------------------------------------------


def _sums(by=""):
    sel, grp = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    cols = ", ".join(f"sum(m{n})::DOUBLE AS m{n}, sum(greatest(h{n}, 1))::DOUBLE AS d{n}"
                     for n in ORDERS)
    return (f"esums AS (SELECT {sel}{cols}, sum(hyp_len)::BIGINT AS hl, sum(ref_len)::BIGINT AS rl "
            f"FROM stats {grp})")


def _sql_eps(sel="", src="esums", m="m{n}", d="d{n}", name="score"):
    ps = [f"(CASE WHEN {m} = 0 THEN 0.1 / {d} ELSE {m} / {d} END)".format(n=n) for n in ORDERS]
    return (f"SELECT {sel}round(CASE WHEN {m.format(n=1)} = 0 THEN 0 ELSE {_geo(ps)} * "
            f"{sql_brevity('rl', 'hl')} END, 6) AS {name} FROM {src}")


query("epsilon_bleu_by_lang", f"WITH {GRAMS}, {sql_stats()}, {_sums('lang')} {_sql_eps('lang, ')}")(
    lambda spark, sf: rounded(S.epsilon_bleu(predictions(spark, sf), "row_id", pred_words(), gold_words(), "lang"),
                              "score").select("lang", "score"))

_ROW_SUMS = "esums AS (SELECT row_id, " + ", ".join(
    f"m{n}::DOUBLE AS m{n}, greatest(h{n}, 1)::DOUBLE AS d{n}" for n in ORDERS
) + ", hyp_len AS hl, ref_len AS rl FROM stats)"
query("sentence_bleu", f"WITH {GRAMS}, {sql_stats()}, {_ROW_SUMS} {_sql_eps('row_id, ')}")(
    lambda spark, sf: rounded(S.sentence_scores(S.pair_stats(
        predictions(spark, sf), ["row_id"], pred_words(), gold_words())), "score").select("row_id", "score"))


def _methods(spark, sf):
    """All corpus-level smoothings side by side."""
    sums = S.total(S.pair_stats(predictions(spark, sf), ["row_id", "lang"], pred_words(), gold_words()), "lang",
                   exprs=S.epsilon_inputs())
    for m in range(5):
        sums = S.smoothed_form(sums, m, out=f"method{m}")
    cols = [f"method{m}" for m in range(5)]
    return rounded(sums, *cols).select("lang", *cols)


def _sql_methods():
    def p(n, zero):
        return f"(CASE WHEN m{n} = 0 THEN {zero} ELSE m{n} / d{n} END)"

    zeros = {n: " + ".join(f"(m{k} = 0)::INT" for k in range(1, n + 1)) for n in ORDERS}
    forms = [
        [p(n, "2.2250738585072014e-308::DOUBLE") for n in ORDERS],
        [p(n, f"0.1 / d{n}") for n in ORDERS],
        [f"((m{n} + 1) / (d{n} + 1))" for n in ORDERS],
        [p(n, f"1 / (pow(2, {zeros[n]}) * d{n})") for n in ORDERS],
        [p(n, f"({n - 1} + 5 / nullif(ln(hl), 0)) / d{n}") for n in ORDERS],
    ]
    bp = sql_brevity("rl", "hl")
    cols = ", ".join(f"round(CASE WHEN m1 = 0 THEN 0 ELSE {_geo(f)} * {bp} END, 6) AS method{i}"
                     for i, f in enumerate(forms))
    return f"SELECT lang, {cols} FROM esums"


query("smoothing_methods", f"WITH {GRAMS}, {sql_stats()}, {_sums('lang')} {_sql_methods()}")(_methods)


def _sentence_smoothing(spark, sf):
    """Per-row smoothings 5, 6 and 7 (they read a fifth order)."""
    stats = S.pair_stats(predictions(spark, sf), ["row_id"], pred_words(), gold_words(), orders=(1, 2, 3, 4, 5))
    out = stats.select("row_id", *[c.alias(k) for k, c in S.epsilon_inputs(orders=(1, 2, 3, 4, 5)).items()])
    for m in (5, 6, 7):
        out = S.smoothed_form(out, m, out=f"method{m}")
    return rounded(out, "method5", "method6", "method7").select("row_id", "method5", "method6", "method7")


_FIFTH = """fifth AS (SELECT row_id, sum(least(h, r))::DOUBLE AS m5, sum(h)::DOUBLE AS h5 FROM (
    SELECT row_id, gram, count(*) FILTER (side = 'h') AS h, count(*) FILTER (side = 'r') AS r FROM (
        SELECT row_id, 'h' AS side, unnest(list_transform(range(1, len(pred) - 3),
            lambda i: array_to_string(pred[i:i + 4], chr(31)))) AS gram FROM predictions UNION ALL
        SELECT row_id, 'r' AS side, unnest(list_transform(range(1, len(gold) - 3),
            lambda i: array_to_string(gold[i:i + 4], chr(31)))) AS gram FROM predictions)
    GROUP BY row_id, gram) GROUP BY row_id)"""


def _sql_sentence_smoothing():
    plain = {n: f"m{n} / d{n}" for n in (1, 2, 3, 4, 5)}
    four = {n: f"(CASE WHEN m{n} = 0 AND hl <> 0 THEN ({n - 1} + 5 / nullif(ln(hl), 0)) / d{n} ELSE m{n} / d{n} END)"
            for n in ORDERS} | {5: plain[5]}

    def averaged(p, tag):
        steps, before = [], f"({p[1]} + 1)"
        for n in ORDERS:
            steps.append(f"({before} + {p[n]} + {p[n + 1]}) / 3 AS {tag}{n}")
            before = f"{tag}{n}"
        return ", ".join(steps)

    p3 = "((m3 + 5 * (CASE WHEN m1 = 0 THEN 0 ELSE (m2/d2) * (m2/d2) / (m1/d1) END)) / (greatest(hl - 2, 0) + 5))"
    bp = sql_brevity("rl", "hl")

    def score(ps):
        return f"round(CASE WHEN m1 = 0 THEN 0 ELSE {_geo(ps)} * {bp} END, 6)"

    return f"""five AS (SELECT e.*, coalesce(m5, 0) AS m5, greatest(coalesce(h5, 0), 1) AS d5
        FROM esums e LEFT JOIN fifth USING (row_id)),
    six AS (SELECT *, {averaged(plain, 'a')}, {averaged(four, 'b')}, {p3} AS c3 FROM five),
    sev AS (SELECT *, (m4 + 5 * (CASE WHEN m2 = 0 THEN 0 ELSE c3 * c3 / (m2/d2) END))
        / (greatest(hl - 3, 0) + 5) AS c4 FROM six)
    SELECT row_id, {score([f'a{n}' for n in ORDERS])} AS method5,
        {score(['m1/d1', 'm2/d2', 'c3', 'c4'])} AS method6,
        {score([f'b{n}' for n in ORDERS])} AS method7 FROM sev"""


# Without two-gram matches method 6 has no value in either engine.
query("sentence_smoothing_5_to_7", f"""WITH {GRAMS}, {sql_stats()}, {_ROW_SUMS}, {_FIFTH},
    {_sql_sentence_smoothing()}""".replace("ln(c3)", "ln(CASE WHEN c3 > 0 THEN c3 END)")
      .replace("ln(c4)", "ln(CASE WHEN c4 > 0 THEN c4 END)")
      .replace("ln(m2/d2)", "ln(CASE WHEN m2 > 0 THEN m2/d2 END)"))(_sentence_smoothing)

query("auto_reweigh", f"""WITH {CONV_GRAMS}, {sql_stats()}, esums AS (SELECT lang AS role, row_id,
        {', '.join(f'm{n}::DOUBLE AS m{n}, greatest(h{n}, 1)::DOUBLE AS d{n}' for n in ORDERS)},
        hyp_len AS hl, ref_len AS rl FROM stats)
    SELECT row_id, round(CASE WHEN m1 = 0 THEN 0 ELSE {sql_brevity('rl', 'hl')} * exp({' + '.join(
        f"(CASE WHEN hl < 4 THEN (CASE WHEN {n} <= hl THEN 1.0::DOUBLE / hl ELSE 0 END) ELSE 0.25 END) * "
        f"ln(CASE WHEN m{n} = 0 THEN 0.1 / d{n} ELSE m{n} / d{n} END)" for n in ORDERS)}) END, 6) AS score
    FROM esums""")(
    lambda spark, sf: rounded(S.smoothed_form(
        S.pair_stats(conversation_pairs(spark, sf), ["row_id"], words("pred"), words("gold")).select(
            "row_id", *[c.alias(k) for k, c in S.epsilon_inputs().items()]), 1, auto_reweigh=True),
        "score").select("row_id", "score"))

# --- keyword-weighted recall -------------------------------------------------------
# The words that count as keywords come from the benchmark table.

BENCH_WORDS = f"kw AS (SELECT DISTINCT unnest({sql_words('text')}) AS word FROM benchmark)"


def bench_words(spark, sf):
    return table(spark, sf, "benchmark").select(F.explode(words("text")).alias("word")).distinct()


def _sql_recall(true_length):
    rl = "sum(ref_len)" if true_length else "2 * count(*)"
    cols = ", ".join(f"sum(m{n})::DOUBLE AS m{n}, sum(greatest(r{n}, 1))::DOUBLE AS d{n}"
                     for n in (2, 3, 4))
    return (f"esums AS (SELECT lang, sum(wm) AS m1, sum(greatest(wr, 1)) AS d1, {cols}, "
            f"sum(hyp_len)::BIGINT AS hl, ({rl})::BIGINT AS rl FROM stats GROUP BY lang) {_sql_eps('lang, ')}")


for _name, _words, _true in (("keyword_recall_java", JAVA_KEYWORDS, False),
                             ("keyword_recall_csharp", C_SHARP_KEYWORDS, False),
                             ("keyword_recall_true_length", JAVA_KEYWORDS, True)):
    query(_name, f"WITH {GRAMS}, {sql_stats(_words)}, {_sql_recall(_true)}")(
        lambda spark, sf, w=_words, t=_true: rounded(S.keyword_recall(
            predictions(spark, sf), "row_id", pred_words(), gold_words(), w, "lang", true_length=t), "score")
        .select("lang", "score"))

query("sentence_keyword_recall", f"""WITH {GRAMS}, {sql_stats(JAVA_KEYWORDS)}, esums AS (
    SELECT row_id, wm AS m1, greatest(wr, 1) AS d1, {', '.join(
        f'm{n}::DOUBLE AS m{n}, greatest(r{n}, 1)::DOUBLE AS d{n}' for n in (2, 3, 4))},
    hyp_len AS hl, 2 AS rl FROM stats) {_sql_eps('row_id, ')}""")(
    lambda spark, sf: rounded(S.smoothed_form(S.pair_stats(
        predictions(spark, sf), ["row_id"], pred_words(), gold_words(), JAVA_KEYWORDS).select(
        "row_id", *[c.alias(k) for k, c in S.keyword_inputs().items()])), "score").select("row_id", "score"))

query("keyword_lookup", f"""WITH {PREDICTIONS}, {BENCH_WORDS}, t AS (
        SELECT lang, unnest(gold) AS word FROM predictions)
    SELECT lang, count(*) AS n, round(sum(CASE WHEN kw.word IS NULL THEN 0.2::DOUBLE ELSE 1 END), 6) AS weight
    FROM t LEFT JOIN kw ON kw.word = t.word GROUP BY lang""")(
    lambda spark, sf: rounded(predictions(spark, sf).select("lang", F.explode(gold_words()).alias("word"))
    .groupBy("lang", "word").agg(F.count("*").alias("c"))
    .join(bench_words(spark, sf).withColumn("w", F.lit(1.0)), "word", "left")
    .groupBy("lang").agg(F.sum("c").alias("n"),
                         F.sum(F.col("c") * F.coalesce("w", F.lit(0.2))).alias("weight")), "weight"))

# --- structure and flow ------------------------------------------------------------
# Feature and edge tables derived from words: bigrams with a depth; a word feeds the next.


def features(spark, sf):
    def sigs(col):
        return let(lambda t: F.transform(t, lambda w, i: F.concat_ws(" ", w, F.get(t, i + 1))), col)

    p = predictions(spark, sf).select(
        "row_id", "lang", gold_words().alias("gold"), pred_words().alias("pred"))
    return p.select("row_id", "lang", F.inline(F.array(*[
        F.struct(F.lit(name).alias("side"), sigs(col).alias("sigs")) for name, col in (("ref", "gold"), ("cand", "pred"))])))


def _sql_sigs(col, side):
    return f"""SELECT row_id, lang, '{side}' AS side, unnest(list_transform({col}, lambda w, i:
        CASE WHEN i < len({col}) THEN w || ' ' || {col}[i + 1] ELSE w END)) AS sig FROM predictions"""


FEATURES = f"""{PREDICTIONS}, features AS ({_sql_sigs('gold', 'ref')} UNION ALL {_sql_sigs('pred', 'cand')}),
    sigs AS (SELECT row_id, lang, sig, count(*) FILTER (side = 'ref') AS r,
             count(*) FILTER (side = 'cand') AS c FROM features GROUP BY ALL)"""

query("structure_match", f"""WITH {FEATURES} SELECT lang,
    coalesce(sum(r) FILTER (c > 0), 0)::BIGINT AS matched, sum(r)::BIGINT AS total,
    round(coalesce(sum(r) FILTER (c > 0), 0)::DOUBLE / sum(r), 6) AS score FROM sigs GROUP BY lang""")(
    lambda spark, sf: rounded(S.structure_match(features(spark, sf), "row_id", "side", "sigs", "lang"),
                              "score"))

query("containment_join", f"""WITH {FEATURES} SELECT lang, count(*) AS n FROM features f
    WHERE side = 'ref' AND EXISTS (SELECT 1 FROM features g WHERE g.side = 'cand'
        AND g.row_id = f.row_id AND g.sig = f.sig) GROUP BY lang""")(
    lambda spark, sf: S.containment(features(spark, sf), "row_id", "side", "sigs", "lang"))


def edges(spark, sf):
    """Conversation turns as flows."""
    return flows(conversation_pairs(spark, sf).select("row_id", words("gold").alias("ref"), words("pred").alias("cand")))


def flows(p):
    """Every word of ``ref`` and ``cand`` feeds the next one."""
    def feeds(col):
        return let(lambda t: F.transform(t, lambda w, i: F.struct(
            i.alias("pos"), w.alias("name"), F.lit("comesFrom").alias("rel"),
            F.when(i > 0, F.array(F.get(t, i - 1))).otherwise(
                F.array().cast("array<string>")).alias("parents"))), col)

    both = p.where(F.col("ref").isNotNull() & F.col("cand").isNotNull())
    return both.select("row_id", F.inline(F.array(*[
        F.struct(F.lit(col).alias("side"), feeds(col).alias("edges")) for col in ("ref", "cand")])))


def _sql_flow(col):
    seen = f"list_distinct_ordered_{col}"
    return f"""{seen} AS (SELECT row_id, list(w ORDER BY began) AS seen FROM (
            SELECT row_id, w, min(pos) AS began FROM (
                SELECT row_id, unnest({col}) AS w, generate_subscripts({col}, 1) AS pos FROM toks)
            GROUP BY row_id, w) GROUP BY row_id),
        flow_{col} AS (SELECT t.row_id, unnest(list_transform({col}, lambda w, i: list_position(seen, w)
            || '|comesFrom|' || CASE WHEN i > 1 THEN list_position(seen, {col}[i - 1])::VARCHAR ELSE '' END))
            AS edge FROM toks t JOIN {seen} s ON s.row_id = t.row_id)"""


query("flow_match", f"""WITH {CONVERSATION_PAIRS}, toks AS (SELECT row_id, {sql_words('gold')} AS ref,
        {sql_words('pred')} AS cand FROM conversation_pairs),
    {_sql_flow('ref')}, {_sql_flow('cand')},
    both_sides AS (SELECT row_id, edge, count(*) FILTER (side = 'ref') AS r,
        count(*) FILTER (side = 'cand') AS c FROM (
        SELECT row_id, edge, 'ref' AS side FROM flow_ref UNION ALL
        SELECT row_id, edge, 'cand' AS side FROM flow_cand) GROUP BY ALL)
    SELECT sum(least(r, c))::BIGINT AS matched, sum(r)::BIGINT AS total,
        round(sum(least(r, c))::DOUBLE / sum(r), 6) AS score FROM both_sides""")(
    lambda spark, sf: rounded(S.flow_match(edges(spark, sf), "row_id", "side"), "score"))

# --- composite ----------------------------------------------------------------------


def _composite(spark, sf):
    """One pass gives the statistics of both n-gram parts."""
    p = predictions(spark, sf)
    stats = S.pair_stats(p, ["row_id"], pred_words(), gold_words(), JAVA_KEYWORDS)
    both = stats.agg(*[F.sum(c).alias(f"e_{k}") for k, c in S.epsilon_inputs().items()],
                     *[F.sum(c).alias(f"k_{k}") for k, c in S.keyword_inputs().items()])

    def part(prefix):
        return S.smoothed_form(both.select(*[F.col(c).alias(c[2:]) for c in both.columns
                                             if c.startswith(prefix)]))

    sides = p.select("row_id", gold_words().alias("ref"), pred_words().alias("cand"))
    parts = {"ngram": part("e_"), "keyword": part("k_"),
             "structure": S.structure_match(features(spark, sf), "row_id", "side", "sigs"),
             "flow": S.flow_match(flows(sides), "row_id", "side")}
    out = S.composite(parts, dict.fromkeys(parts, 0.25))
    return rounded(out, *out.columns)


query("composite_score", f"""WITH {FEATURES}{GRAMS[len(PREDICTIONS):]}, {sql_stats(JAVA_KEYWORDS)},
    e AS (SELECT {', '.join(f'sum(m{n})::DOUBLE AS m{n}, sum(greatest(h{n}, 1))::DOUBLE AS d{n}' for n in ORDERS)},
          sum(hyp_len)::BIGINT AS hl, sum(ref_len)::BIGINT AS rl FROM stats),
    k AS (SELECT sum(wm) AS m1, sum(greatest(wr, 1)) AS d1, {', '.join(
        f'sum(m{n})::DOUBLE AS m{n}, sum(greatest(r{n}, 1))::DOUBLE AS d{n}' for n in (2, 3, 4))},
          sum(hyp_len)::BIGINT AS hl, (2 * count(*))::BIGINT AS rl FROM stats),
    x AS ({_sql_eps(src='e', name='ngram').replace(', 6)', ', 12)')}),
    y AS ({_sql_eps(src='k', name='keyword').replace(', 6)', ', 12)')}),
    z AS (SELECT coalesce(sum(r) FILTER (c > 0), 0)::DOUBLE / sum(r) AS structure FROM sigs),
    toks AS (SELECT row_id, gold AS ref, pred AS cand FROM predictions), {_sql_flow('ref')}, {_sql_flow('cand')},
    v AS (SELECT sum(least(r, c))::DOUBLE / sum(r) AS flow FROM (SELECT row_id, edge, count(*) FILTER (side = 'ref') AS r,
        count(*) FILTER (side = 'cand') AS c FROM (SELECT row_id, edge, 'ref' AS side FROM flow_ref UNION ALL
        SELECT row_id, edge, 'cand' FROM flow_cand) GROUP BY ALL))
    SELECT round(ngram, 6) AS ngram, round(keyword, 6) AS keyword, round(structure, 6) AS structure, round(flow, 6) AS flow,
        round(0.25 * ngram + 0.25 * keyword + 0.25 * structure + 0.25 * flow, 6) AS composite FROM x, y, z, v""")(_composite)

# --- edit-aware score ----------------------------------------------------------------


def _sql_gleu_rows(grams="grams", preds="predictions", slices="lang"):
    g = ", ".join(f"""greatest(coalesce(sum(least(h, r) - CASE WHEN r = 0 THEN least(h, s) ELSE 0 END)
        FILTER (n = {n}), 0), 0)::BIGINT AS g{n}, coalesce(sum(h) FILTER (n = {n}), 0)::BIGINT AS d{n}"""
                  for n in ORDERS)
    return f"""grows AS (SELECT p.row_id, p.{slices}, len(p.pred) AS hl, len(p.gold) AS rl, x.* EXCLUDE (row_id)
        FROM {preds} p JOIN (SELECT row_id, {g} FROM {grams} GROUP BY row_id) x ON x.row_id = p.row_id)"""


def _sql_gleu(by="lang", src="grows", digits=6):
    sums = ", ".join(f"sum(g{n})::DOUBLE AS g{n}, sum(d{n})::DOUBLE AS d{n}" for n in ORDERS)
    sel, grp = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    zero = "least(hl, rl, " + ", ".join(f"g{n}, d{n}" for n in ORDERS) + ") = 0"
    return f"""SELECT {sel}round(CASE WHEN {zero} THEN 0 ELSE exp(least(0, 1 - rl / hl)) *
        {_geo(f'g{n} / d{n}' for n in ORDERS)} END, {digits}) AS gleu FROM (
        SELECT {sel}{sums}, sum(hl)::DOUBLE AS hl, sum(rl)::DOUBLE AS rl FROM {src} {grp})"""


query("gleu_by_lang", f"WITH {GRAMS}, {_sql_gleu_rows()} {_sql_gleu()}")(
    lambda spark, sf: rounded(S.gleu(predictions(spark, sf), "row_id", src_words(), pred_words(), gold_words(), "lang"),
                              "gleu").select("lang", "gleu"))

_WITH_NULLS = PREDICTIONS.replace("predictions AS ", "predictions0 AS ") + """, predictions AS MATERIALIZED (
    SELECT * REPLACE (CASE WHEN row_id % 4 = 0 THEN source ELSE pred END AS pred) FROM predictions0)"""
query("gleu_missing_hypothesis", f"""WITH {_WITH_NULLS}{GRAMS[len(PREDICTIONS):]}, {_sql_gleu_rows()}
    {_sql_gleu()}""")(
    lambda spark, sf: rounded(S.gleu(
        predictions(spark, sf), "row_id", src_words(),
        F.when(F.col("row_id") % 4 != 0, pred_words()), gold_words(), "lang"), "gleu").select("lang", "gleu"))

_TOK_MATCH = """lower(coalesce(array_to_string(list_filter({c}, lambda t:
    regexp_matches(t, '\\A[\\p{{L}}\\p{{N}}]+\\z')), ''), ''))"""
query("edit_bundle", f"""WITH {GRAMS}, {_sql_gleu_rows()}
    SELECT 'gleu' AS metric, gleu AS value FROM ({_sql_gleu('')}) UNION ALL
    SELECT 'acc', round(100 * avg(CASE WHEN {_TOK_MATCH.format(c='pred')} = {_TOK_MATCH.format(c='gold')}
        THEN 1.0::DOUBLE ELSE 0 END), 6) FROM predictions""")(
    lambda spark, sf: rounded(S.edit_bundle(predictions(spark, sf), "row_id", src_words(), pred_words(), gold_words()),
                              "value"))

query("ngram_document_frequency", f"""WITH {GRAMS} SELECT n, replace(gram, chr(31), ' ') AS gram,
    count(*) AS df FROM grams WHERE r > 0 GROUP BY ALL""")(
    lambda spark, sf: document_frequency(
        gram_counts(predictions(spark, sf), ["row_id"], {"r": gold_words()}, nested=True), "r")
    .select("n", F.replace("gram", F.lit("\u001f"), F.lit(" ")).alias("gram"), "df"))

query("ngram_normalizer", f"""WITH {GRAMS}, f AS (SELECT n, gram, count(*) AS df FROM grams WHERE r > 0 GROUP BY ALL),
    t AS (SELECT count(*) AS n_rows FROM predictions)
    SELECT n, count(*) AS n_grams, round(sum(df::DOUBLE / n_rows), 4) AS weight FROM f, t GROUP BY n""")(
    lambda spark, sf: _normalizer(predictions(spark, sf)))


def _normalizer(p):
    counts = gram_counts(p, ["row_id"], {"r": gold_words()}, nested=True)
    per_order = document_frequency(counts, "r").groupBy("n").agg(F.count("*").alias("n_grams"), F.sum("df").alias("_df"))
    rows = p.select("row_id").distinct().count()
    return per_order.select("n", "n_grams", F.round(F.col("_df") / F.lit(rows), 4).alias("weight"))


def _boot(spark, sf):
    stats = S.gleu_stats(predictions(spark, sf), ["row_id"], src_words(), pred_words(), gold_words())
    return rounded(S.bootstrap(stats, "row_id", 10, S.gleu_form, "gleu"), "mean", "std", "low", "high")


_U = sql_draw("boot", "row_id", "round")
_STEPS = S.poisson_steps()
query("bootstrap_interval", f"""WITH {GRAMS}, {_sql_gleu_rows()}, b AS (SELECT *, {' + '.join(
        f'({_U} >= {s}::DOUBLE)::INT' for s in _STEPS)} AS w FROM grows, unnest(range(1, 11)) t(round)),
    wr AS (SELECT round AS lang, w * hl AS hl, w * rl AS rl, {', '.join(
        f'w * g{n} AS g{n}, w * d{n} AS d{n}' for n in ORDERS)} FROM b),
    sc AS ({_sql_gleu('lang', 'wr', 15)})
    SELECT round(avg(gleu), 6) AS mean, round(stddev_pop(gleu), 6) AS std,
        round(avg(gleu) - 1.959964 * stddev_pop(gleu), 6) AS low,
        round(avg(gleu) + 1.959964 * stddev_pop(gleu), 6) AS high FROM sc""")(_boot)

# --- several references -----------------------------------------------------------------
# Each document has three references: its gold edit and two more edits.

def references(spark, sf):
    d = documents(spark, sf)
    return d.select(F.col("doc_id").alias("row_id"), F.posexplode(F.array(*[
        edited(F.col("text"), s, "doc_id") for s in ("edit", "ref1", "ref2")]))
        .alias("ref_id", "ref_text"))


_REFS = PREDICTIONS + ", refs AS (" + " UNION ALL ".join(
    f"""SELECT doc_id AS row_id, {i} AS ref_id,
        {sql_words("coalesce(" + sql_edited('text', s, 'doc_id') + ", '')")} AS ref FROM documents"""
    for i, s in enumerate(("edit", "ref1", "ref2"))) + ")"
_MULTI = _REFS + """, rg AS (SELECT row_id, n, gram, max(c) AS r FROM (
        SELECT row_id, ref_id, n, gram, count(*) AS c FROM (""" + " UNION ALL ".join(
    f"""SELECT row_id, ref_id, {n} AS n, unnest(list_transform(range(1, len(ref) - {n} + 2),
        lambda i: array_to_string(ref[i:i + {n - 1}], chr(31)))) AS gram FROM refs""" for n in ORDERS) + """)
        GROUP BY ALL) GROUP BY ALL),
    hg AS (SELECT row_id, n, gram, count(*) AS h FROM (""" + " UNION ALL ".join(
    f"""SELECT row_id, {n} AS n, unnest(list_transform(range(1, len(pred) - {n} + 2),
        lambda i: array_to_string(pred[i:i + {n - 1}], chr(31)))) AS gram FROM predictions""" for n in ORDERS) + """)
        GROUP BY ALL),
    lens AS (SELECT p.row_id, len(pred) AS hl, min(len(ref)) AS sl,
             min({'gap': abs(len(ref) - len(pred)), 'l': len(ref)}).l AS cl
             FROM predictions p JOIN refs USING (row_id) GROUP BY p.row_id, len(pred)),
    ms AS (SELECT row_id, """ + ", ".join(
    f"coalesce(sum(least(h, coalesce(r, 0))) FILTER (n = {n}), 0) AS m{n}, coalesce(sum(h) FILTER (n = {n}), 0) AS h{n}"
    for n in ORDERS) + """ FROM hg LEFT JOIN rg USING (row_id, n, gram) GROUP BY row_id),
    mr AS (SELECT lens.*, """ + ", ".join(f"coalesce(m{n}, 0) AS m{n}, coalesce(h{n}, 0) AS h{n}"
                                         for n in ORDERS) + " FROM lens LEFT JOIN ms USING (row_id))"


def _multi(spark, sf):
    stats = S.multi_ref_stats(predictions(spark, sf), references(spark, sf), "row_id", pred_words(),
                              words("ref_text"), "ref_id")
    sums = stats.agg(*[F.sum(c).alias(c) for c in stats.columns if c not in ("row_id",)],
                     *[F.sum(F.greatest(F.col(f"h{n}"), F.lit(1))).alias(f"den{n}") for n in ORDERS])
    plus = S.bleu_form(sums)
    eps = S.smoothed_form(plus.select("bleu", "hyp_len", F.col("close_len").alias("ref_len"), *[
        F.col(f"m{n}").alias(f"num{n}") for n in ORDERS], *[f"den{n}" for n in ORDERS]))
    return rounded(eps.select("bleu", "score"), "bleu", "score")


query("multi_reference_bleu", f"""WITH {_MULTI}, t AS (SELECT {', '.join(
        f'sum(m{n})::DOUBLE AS m{n}, sum(h{n})::DOUBLE AS h{n}, sum(greatest(h{n}, 1))::DOUBLE AS d{n}' for n in ORDERS)},
        sum(hl)::BIGINT AS hl, sum(sl)::BIGINT AS sl, sum(cl)::BIGINT AS rl FROM mr)
    SELECT round({_geo(f'(m{n} + 1) / (h{n} + 1)' for n in ORDERS)} * {sql_brevity('sl', 'hl')}, 6) AS bleu,
        score FROM t, ({_sql_eps(src='t')})""")(_multi)

query("multi_reference_gleu", f"""WITH {_REFS}, pick AS (SELECT row_id, arg_min(ref, {sql_draw('g', 'row_id', 'ref_id')}) AS ref
        FROM refs GROUP BY row_id),
    chosen AS (SELECT p.row_id, p.lang, p.source, pick.ref AS gold, p.pred FROM predictions p JOIN pick USING (row_id)),
    {GRAMS[len(PREDICTIONS) + 2:].replace('FROM predictions', 'FROM chosen')}, {_sql_gleu_rows(preds='chosen')} {_sql_gleu('')}""")(
    lambda spark, sf: rounded(S.gleu_multi(predictions(spark, sf), references(spark, sf), "row_id", src_words(),
                                           pred_words(), "ref_text", "ref_id", seed="g"), "gleu").select("gleu"))
