"""The same queries as SQL over the same tables, for an independent engine.

Written from the definitions, not from the Spark plans: thresholds are compared
one by one, pairs come from self-joins, ranks from plain windows.
"""

from __future__ import annotations

import unicodedata

from labelspark import queries as Q
from labelspark.operators import features as X
from labelspark.operators import sketches as K

# --- shared pieces ---------------------------------------------------------

SPLIT = "CASE WHEN {0} % 10 < 8 THEN 'train' WHEN {0} % 10 = 8 THEN 'validation' ELSE 'test' END"

ORDERS = f"""
  pairs AS (SELECT DISTINCT l_orderkey AS row_id, p_brand AS label
            FROM lineitem JOIN part ON l_partkey = p_partkey),
  heads AS (SELECT o_orderkey AS row_id, o_orderpriority AS source, {SPLIT.format('o_orderkey')} AS split FROM orders),
  long AS (SELECT row_id, source, split, label FROM pairs JOIN heads USING (row_id)),
  lrows AS (SELECT row_id, source, split, list(label ORDER BY label) AS labels FROM long GROUP BY ALL)
"""

# brands and one rare label per part
PARTS = f"""
  pairs AS (SELECT DISTINCT l_orderkey AS row_id, unnest([p_brand, 'P' || l_partkey]) AS label
            FROM lineitem JOIN part ON l_partkey = p_partkey),
  heads AS (SELECT o_orderkey AS row_id, o_orderpriority AS source, {SPLIT.format('o_orderkey')} AS split FROM orders),
  long AS (SELECT row_id, source, split, label FROM pairs JOIN heads USING (row_id))
"""

CORPUS = """
  corpus AS (SELECT doc_id AS row_id, text, source,
                    CASE WHEN n < 8 THEN 'train' WHEN n = 8 THEN 'validation' ELSE 'test' END AS split
             FROM (SELECT *, regexp_extract(source, '(\\d+)', 1)::INT % 10 AS n FROM documents))
"""

LABELLED = f"""
  labelled AS (SELECT d.doc_id AS row_id, text, source, lang, {SPLIT.format('d.doc_id')} AS split,
                      list_filter([lang, CASE WHEN quality = 1 THEN 'quality' END,
                                   CASE WHEN toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL) AS labels
               FROM documents d LEFT JOIN labels m ON d.doc_id = m.doc_id)
"""

CELLS = f"""
  cells AS (SELECT row_id, split, label_id, x, 1 / (1 + exp(-x)) AS score, (label = label_id)::BIGINT AS truth
            FROM (SELECT vec_id AS row_id, {SPLIT.format('vec_id')} AS split, label,
                         unnest(range(len(embedding))) AS label_id,
                         unnest(embedding)::DOUBLE * 8 AS x FROM embeddings))
"""

TWO = f"""
  lines AS (SELECT l_orderkey AS row_id, {SPLIT.format('l_orderkey')} AS split, p_brand AS label, l_discount, l_quantity
            FROM lineitem JOIN part ON l_partkey = p_partkey),
  truth AS (SELECT DISTINCT split, row_id, label FROM lines WHERE l_discount >= 0.03),
  guess AS (SELECT DISTINCT split, row_id, label FROM lines WHERE l_quantity >= 15)
"""

WS = r"[\s\x0b\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def scored(counts: str) -> str:
    """Metric columns over tp, fp, fn, tn."""
    return f"""*, round(CASE WHEN tp + fp = 0 THEN 1 ELSE tp / (tp + fp)::DOUBLE END, 6) AS precision,
      round(CASE WHEN tp + fn = 0 THEN 1 ELSE tp / (tp + fn)::DOUBLE END, 6) AS recall,
      round(CASE WHEN 2 * tp + fp + fn = 0 THEN 1 ELSE 2 * tp / (2 * tp + fp + fn)::DOUBLE END, 6) AS f1,
      round(CASE WHEN tp + fn > 0 AND tn + fp > 0
                 THEN (tp / (tp + fn)::DOUBLE + tn / (tn + fp)::DOUBLE) / 2 END, 6) AS auc_score
      FROM {counts}"""


def counted(hit: str) -> str:
    return f"""sum(CASE WHEN {hit} THEN truth ELSE 0 END)::BIGINT AS tp,
      sum(CASE WHEN {hit} THEN 1 - truth ELSE 0 END)::BIGINT AS fp,
      sum(CASE WHEN {hit} THEN 0 ELSE truth END)::BIGINT AS fn,
      sum(CASE WHEN {hit} THEN 0 ELSE 1 - truth END)::BIGINT AS tn"""


def rewrite(text: str, rules: list[tuple[str, str]]) -> str:
    for pattern, replacement in rules:
        text = f"regexp_replace({text}, '{pattern}', '{replacement}', 'g')"
    return text


QUOTES = r"[\x{b4}\x{2032}\x{2019}\x{2bc}\x{2018}\x{2bb}`]"
DASHES = r"[\x{2212}\x{2010}\x{2013}\x{2014}]"
CLEAN = [
    (QUOTES, "''"), (DASHES, "-"), ("æ", "ae"), ("œ", "oe"), (f"{WS}*''{WS}*", "''"), (f"{WS}+([,.])", r"\1"),
    (rf"\({WS}+", "("), (rf"{WS}+\)", ")"), (f"{WS}*/{WS}*", "/"),
]
FEATURE = [
    (QUOTES, "''"), (DASHES, "-"), (f"{WS}*''{WS}*", "'' "), (f"{WS}*([,.:;!?])", r" \1"),
    (f"{WS}*([-/]){WS}*", r" \1 "), (rf"\({WS}*", "( "), (rf"{WS}*\)", " )"), ("æ", "ae"), ("œ", "oe"),
    (f"{WS}+", " "), (f"^{WS}+|{WS}+$", ""),
]
BAG = [(f"{WS}*''{WS}*", "'' "), ("æ", "ae"), ("œ", "oe"), (f"{WS}+", " "), (f"^{WS}+|{WS}+$", "")]


def nfkd(text: str) -> str:
    """Decompose the lower-case letters of the Latin blocks; the engine has no NFKD."""
    for code in [*range(0xDF, 0x180)]:
        letter = chr(code)
        if letter == letter.lower() and unicodedata.normalize("NFKD", letter) != letter and letter.isalpha():
            text = f"replace({text}, chr({code}), '{unicodedata.normalize('NFKD', letter)}')"
    return text


def no_symbols(text: str) -> str:
    """Marks, symbols and punctuation but the apostrophe become blanks."""
    held = f"replace({text}, '''', chr(57344))"
    return f"replace(regexp_replace({held}, '[\\p{{M}}\\p{{S}}\\p{{P}}]', ' ', 'g'), chr(57344), '''')"


BAG_TEXT = rewrite(no_symbols("nfc_normalize(lower(text))"), BAG)
TOKENS = r"regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]{{2,}}')"
LOWER_TOKENS = TOKENS.format("lower(text)")
STOP = "[" + ", ".join(f"'{w}'" for w in Q.STOPWORDS) + "]"
STEM = "regexp_replace({0}, '(?:aux|en|er|x|s)$', '')"


def hashed(seed: str, *parts: str) -> str:
    return f"md5(concat_ws(':', '{seed}', {', '.join(parts)}))"


def to_int(h: str) -> str:
    return f"('0x' || substr({h}, 1, 13))::BIGINT"


def profile(sets: str) -> str:
    return f"""WITH {LABELLED},
      sub AS (SELECT * FROM labelled),
      words AS (SELECT coalesce(source, 'all') AS source, coalesce(split, 'all') AS split, count(*) AS num_examples,
                  avg(len(list_filter(string_split_regex(text, '{WS}+'), lambda x: x <> ''))) AS avg_words,
                  sum(len(labels))::BIGINT AS num_labels, avg(len(labels)) AS avg_labels
                FROM sub GROUP BY {sets}),
      cnt AS (SELECT coalesce(source, 'all') AS source, coalesce(split, 'all') AS split, label, count(*) AS n
              FROM (SELECT source, split, unnest(labels) AS label FROM sub)
              GROUP BY {sets.replace('(', '(label, ').replace(', )', ')') if 'SETS' not in sets else 'GROUPING SETS ((source, split, label), (source, label), (split, label), (label))'}),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY source, split ORDER BY n DESC, label) AS r FROM cnt),
      lab AS (SELECT source, split, count(*) AS num_unique_labels, avg(n) AS avg_label_freq, max(n) / min(n)::DOUBLE AS imbalance,
                string_agg(CASE WHEN r <= 5 THEN label || '(' || n || ')' END, ', ' ORDER BY r) AS top_labels
              FROM ranked GROUP BY source, split)
      SELECT source, split, num_examples, num_labels, num_unique_labels, top_labels, round(avg_words, 6) AS avg_words,
        round(avg_labels, 6) AS avg_labels, round(avg_label_freq, 6) AS avg_label_freq, round(imbalance, 6) AS imbalance
      FROM words JOIN lab USING (source, split)"""


def coverage() -> str:
    one = """SELECT '{a}' AS split_a, '{b}' AS split_b,
      (SELECT count(DISTINCT label) FROM long WHERE split = '{a}') AS size_a,
      (SELECT count(DISTINCT label) FROM long WHERE split = '{b}') AS size_b,
      (SELECT count(*) FROM (SELECT label FROM long WHERE split = '{b}' EXCEPT SELECT label FROM long WHERE split = '{a}')) AS missing"""
    union = " UNION ALL ".join(
        one.format(a=a, b=b) for a, b in (("train", "validation"), ("train", "test"), ("validation", "test"))
    )
    return f"WITH {PARTS} SELECT *, round(100.0::DOUBLE * missing / size_b, 6) AS pct FROM ({union})"


GRID = f"""
  g AS (SELECT 0.01::DOUBLE + i * 0.05::DOUBLE AS threshold FROM range(20) t(i)),
  grid AS (SELECT split, threshold, {counted('score >= threshold')} FROM cells CROSS JOIN g GROUP BY ALL),
  total AS (SELECT threshold, {counted('score >= threshold')} FROM cells CROSS JOIN g GROUP BY ALL)
"""

BUCKET = "CASE WHEN n >= 100 THEN 'head' WHEN n >= 20 THEN 'medium' ELSE 'tail' END"
TRAIN_BUCKETS = f"""
  cnt AS (SELECT label, count(*) AS n FROM long WHERE split = 'train' GROUP BY label),
  buckets AS (SELECT label, {BUCKET} AS bucket FROM cnt)
"""

# --- losses ----------------------------------------------------------------

CLASSES = """
  pos AS (SELECT c.label_id, count(e.label) AS n
          FROM (SELECT unnest(range(64)) AS label_id) c LEFT JOIN embeddings e ON e.label = c.label_id GROUP BY 1),
  size AS (SELECT count(*) AS n_rows FROM embeddings),
  par AS (SELECT label_id, n, CASE WHEN n = 0 THEN 1 ELSE (n_rows - n) / n::DOUBLE END AS w_pos,
            CASE WHEN n = 0 THEN 0 ELSE 1 / sqrt(n) END AS i_raw,
            CASE WHEN n = 0 THEN 0 ELSE (1 - 0.99::DOUBLE) / (1 - pow(0.99::DOUBLE, n)) END AS c_raw,
            -ln(sum(n) OVER () / (n + 1e-8::DOUBLE) - 1) * 0.05::DOUBLE AS bias
          FROM pos CROSS JOIN size),
  weights AS (SELECT label_id, n, w_pos, bias, i_raw * count(*) OVER () / sum(i_raw) OVER () AS w_inv,
                c_raw * count(*) OVER () / sum(c_raw) OVER () AS w_cb FROM par)
"""


def _bce(x: str) -> str:
    return f"(greatest({x}, 0) - ({x}) * truth + ln(1 + exp(-abs({x}))))"


def _focal(x: str) -> str:
    return f"(0.5 * pow(1 - exp(-{_bce(x)}), 2) * {_bce(x)})"


TOLERANT = "(CASE WHEN truth = 1 THEN x + bias ELSE 2 * (x + bias) END)"
TOLERANT_W = "(CASE WHEN truth = 1 THEN w_cb ELSE w_cb / 2 END)"
LOSSES = {
    "bce": _bce("x"),
    "pos-weighted-bce": "(CASE WHEN truth = 1 THEN w_pos * ln(1 + exp(-x)) ELSE ln(1 + exp(x)) END)",
    "weighted-bce": f"w_inv * {_bce('x')}",
    "fl": f"5 * {_focal('x')}",
    "cb": f"w_cb * {_bce('x')}",
    "cb-fl": f"w_cb * {_focal('x')}",
    "ntr": _bce(TOLERANT),
    "ntr-fl": _focal(TOLERANT),
    "cb-ntr": f"{TOLERANT_W} * {_bce(TOLERANT)}",
    "cb-ntr-fl": f"{TOLERANT_W} * {_focal(TOLERANT)}",
}

ANSWERS = f"""
  shaped AS (SELECT row_id, row_id % 8 AS s, array_to_string(labels, ', ') AS codes, array_to_string(labels, ' , ') AS spaced FROM lrows),
  bodies AS (SELECT *, '### Analysis and Code Assignment' || chr(10) || chr(10) || 'Why.' || chr(10) || chr(10) || '### Result' || chr(10) || chr(10) || codes AS body FROM shaped),
  answers AS (SELECT row_id, CASE WHEN row_id % 11 = 3 THEN NULL ELSE CASE s
      WHEN 0 THEN '```' || chr(10) || body || chr(10) || '```'
      WHEN 1 THEN body
      WHEN 2 THEN '## result' || chr(10) || codes
      WHEN 3 THEN body || chr(10) || '## ANALYSIS' || chr(10) || 'more'
      WHEN 4 THEN '### Analysis' || chr(10) || 'none' || chr(10) || '### Result' || chr(10) || '0'
      WHEN 5 THEN '### analysis' || chr(10) || 'x' || chr(10) || chr(10) || '## Result' || chr(10) || spaced || ','
      WHEN 6 THEN body || chr(10) || '``` '
      ELSE body || chr(10) || '```' || chr(10) END END AS output FROM bodies),
  cut AS (SELECT row_id, output, string_split_regex(
            regexp_replace(regexp_replace(output, '^```', ''), '```(\\n?)$', '\\1'),
            '(?i)#{{2,3}} (?:Analysis and Code Assignment|Analysis|Result)')[2:] AS parts FROM answers),
  parsed AS (SELECT row_id, output, len(parts) AS n_parts,
               list_filter(string_split_regex(regexp_replace(parts[2], '^{WS}+|{WS}+$', '', 'g'), ',{WS}*'),
                           lambda c: c NOT IN ('0', '')) AS labels FROM cut)
"""

VECTORS = f"""{LABELLED},
  toks AS (SELECT row_id, split, unnest({LOWER_TOKENS}) AS term FROM labelled),
  terms AS (SELECT row_id, split, term, count(*) AS tf FROM toks GROUP BY ALL),
  vocabulary AS (SELECT term, n_docs, row_number() OVER (ORDER BY term) - 1 AS index,
      ln((1 + (SELECT count(*) FROM labelled WHERE split = 'train')) / (1 + n_docs)::DOUBLE) + 1 AS idf
    FROM (SELECT term, count(*) AS n_docs FROM terms WHERE split = 'train' GROUP BY term)),
  raws AS (SELECT row_id, split, term, tf * idf AS raw FROM terms JOIN vocabulary USING (term)),
  x AS (SELECT row_id, split, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY row_id)) AS v FROM raws)
"""


def linear_steps(kind: str, c: float, steps: int) -> str:
    """Accelerated full-batch steps of six balanced linear models, as tables
    w{steps} (term, label, w) and b{steps} (label, b)."""
    bound = 0.5 if kind == "lr" else 4.0
    error = (
        "1 / (1 + exp(-m)) - y" if kind == "lr" else "-2 * (2 * y - 1) * greatest(0, 1 - (2 * y - 1) * m)"
    )
    text = f"""
  cells AS (SELECT row_id, split, label, list_contains(labels, label)::INT AS y
            FROM labelled CROSS JOIN (SELECT unnest(['de', 'en', 'es', 'fr', 'quality', 'toxic']) AS label)),
  size AS (SELECT count(*)::DOUBLE AS n FROM labelled WHERE split = 'train'),
  rate AS (SELECT 1 / ({c} * n) AS penalty, 1 / ({bound} + 1 / ({c} * n)) AS rate, n FROM size),
  train AS (SELECT row_id, label, y, CASE y WHEN 1 THEN n / (2 * p) ELSE n / (2 * (n - p)) END AS s
            FROM (SELECT *, sum(y) OVER (PARTITION BY label) AS p FROM cells WHERE split = 'train') CROSS JOIN size),
  xt AS (SELECT row_id, term, v FROM x WHERE split = 'train'),
  w0 AS (SELECT term, label, 0::DOUBLE AS w, 0::DOUBLE AS a FROM vocabulary CROSS JOIN (SELECT DISTINCT label FROM cells)),
  b0 AS (SELECT DISTINCT label, 0::DOUBLE AS b, 0::DOUBLE AS a FROM cells)"""
    for i in range(steps):
        push = i / (i + 3.0)
        text += f""",
  m{i} AS (SELECT row_id, label, sum(v * a) AS m FROM xt JOIN w{i} USING (term) GROUP BY ALL),
  e{i} AS (SELECT row_id, label, s * ({error}) / n AS e FROM (
            SELECT row_id, label, y, s, coalesce(m, 0) + a AS m FROM train LEFT JOIN m{i} USING (row_id, label) JOIN b{i} USING (label))
          CROSS JOIN size),
  g{i} AS (SELECT term, label, sum(v * e) AS g FROM xt JOIN e{i} USING (row_id) GROUP BY ALL),
  n{i} AS (SELECT term, label, w, a - rate * (g + penalty * a) AS z FROM w{i} JOIN g{i} USING (term, label) CROSS JOIN rate),
  w{i + 1} AS (SELECT term, label, z AS w, z + {push} * (z - w) AS a FROM n{i}),
  b{i + 1} AS (SELECT label, z AS b, z + {push} * (z - b) AS a FROM (
            SELECT label, b, a - rate * g AS z FROM b{i} JOIN (SELECT label, sum(e) AS g FROM e{i} GROUP BY label) USING (label) CROSS JOIN rate))"""
    return text + f""",
  margins AS (SELECT row_id, label, sum(v * w) AS m FROM x JOIN w{steps} USING (term) GROUP BY ALL),
  judged AS (SELECT split, y, (coalesce(m, 0) + b >= 0)::INT AS p FROM cells LEFT JOIN margins USING (row_id, label) JOIN b{steps} USING (label))"""


def linear_counts() -> str:
    return """SELECT split, sum(y * p)::BIGINT AS tp, sum((1 - y) * p)::BIGINT AS fp, sum(y * (1 - p))::BIGINT AS fn,
      sum((1 - y) * (1 - p))::BIGINT AS tn FROM judged GROUP BY split"""


BRANDS = """
  brands AS (SELECT p_brand AS code, min(p_type) AS description, regexp_extract(p_brand, '(\\d+)', 1)::BIGINT AS ord
             FROM part GROUP BY p_brand)
"""

SAMPLED = f"""
  wanted AS (SELECT doc_id AS row_id, 1 + {to_int(hashed('5', 'doc_id', "'size'"))} % 5 AS k FROM documents),
  freqs AS (SELECT label AS code, count(*)::DOUBLE AS n FROM long GROUP BY label),
  spans AS (SELECT code, sum(n) OVER (ORDER BY code) - n AS low, n AS w FROM freqs),
  steps AS (
    SELECT row_id, k, 0::BIGINT AS pos, []::STRUCT(low DOUBLE, w DOUBLE)[] AS taken, ''::VARCHAR AS code FROM wanted
    UNION ALL
    SELECT s.row_id, s.k, s.pos + 1, list_append(s.taken, {{'low': s.low, 'w': s.w}}), s.code FROM (
      SELECT p.*, c.low, c.w, c.code,
        coalesce(list_sum(list_transform(list_filter(p.taken, lambda t: t.low < c.low), lambda t: t.w)), 0) AS gone
      FROM (SELECT row_id, k, pos, taken, {to_int(hashed('5', 'row_id', 'pos'))} / pow(2, 52)
              * ((SELECT sum(n) FROM freqs) - coalesce(list_sum(list_transform(taken, lambda t: t.w)), 0)) AS v
            FROM steps WHERE pos < k) p
      JOIN spans c ON NOT list_contains(list_transform(p.taken, lambda t: t.low), c.low)) s
    WHERE v >= s.low - s.gone AND v < s.low - s.gone + s.w),
  sampled AS (SELECT row_id, pos, code FROM steps WHERE pos > 0)
"""


def items(values: list[str], purpose: str) -> str:
    listed = ", ".join(f"'{v}'" for v in values)
    return f"""SELECT doc_id AS row_id, string_agg(item, chr(10) ORDER BY h) AS {purpose} FROM (
        SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY h) AS r FROM (
          SELECT doc_id, item, {hashed('6', 'doc_id', f"'{purpose}'", 'i')} AS h FROM documents
          CROSS JOIN (SELECT unnest([{listed}]) AS item, unnest(range({len(values)})) AS i)))
      WHERE r <= 3 GROUP BY doc_id"""


TYPES = ["- note", "- letter", "- report", "- summary", "- form"]
STYLES = ["- long", "- short", "- {plain}", "- formal"]


def cut_sql(table: str, row_id: str, seed: str, cases: str, rest: str) -> str:
    return f"""SELECT * EXCLUDE (r, t), CASE {cases} ELSE '{rest}' END AS split FROM (
      SELECT {row_id}, row_number() OVER (ORDER BY {hashed(seed, row_id)}, {row_id}) AS r, count(*) OVER () AS t FROM {table})"""


def oracle_sql() -> dict[str, str]:
    sql: dict[str, str] = {}

    # labels
    sql["label_vocab"] = f"WITH {PARTS} SELECT label, row_number() OVER (ORDER BY label) - 1 AS label_id FROM (SELECT DISTINCT label FROM long)"
    sql["label_freq"] = f"WITH {ORDERS} SELECT split, label, count(*) AS n FROM long GROUP BY ALL"
    sql["label_freq_norm"] = f"""WITH {ORDERS} SELECT split, label,
      round(count(*) / sum(count(*)) OVER (PARTITION BY split), 6)::DOUBLE AS freq FROM long GROUP BY split, label"""
    sql["label_rank"] = f"""WITH {PARTS} SELECT split, label, count(*) AS n,
      row_number() OVER (PARTITION BY split ORDER BY count(*) DESC, label) AS rank FROM long GROUP BY split, label"""
    sql["top_labels"] = f"WITH {PARTS} SELECT label, count(*) AS n FROM long GROUP BY label ORDER BY n DESC, label LIMIT 5"
    sql["multi_hot"] = f"""WITH {ORDERS}, names AS (SELECT DISTINCT label AS name FROM long)
      SELECT row_id, string_agg(CASE WHEN list_contains(labels, name) THEN '1' ELSE '0' END, '' ORDER BY name) AS hot
      FROM lrows CROSS JOIN names GROUP BY row_id"""
    sql["decode_labels"] = f"WITH {ORDERS} SELECT row_id, array_to_string(labels, ',') AS labels FROM lrows"
    sql["single_label_encode"] = """WITH o AS (SELECT o_orderkey AS row_id,
        CASE WHEN o_orderstatus = 'P' THEN '-1' ELSE o_orderpriority END AS label FROM orders),
      v AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS label_id FROM (SELECT DISTINCT label FROM o WHERE label <> '-1'))
      SELECT row_id, label, coalesce(label_id, -1) AS label_id FROM o LEFT JOIN v USING (label)"""
    sql["missing_labels"] = f"""WITH {PARTS} SELECT label FROM long WHERE split <> 'train'
      EXCEPT SELECT label FROM long WHERE split = 'train'"""

    # profile
    sql["dataset_profile"] = profile("(source, split)").replace("GROUP BY (source, split)", "GROUP BY source, split").replace(
        "GROUP BY (label, source, split)", "GROUP BY source, split, label")
    sql["profile_grouping_sets"] = profile("GROUPING SETS ((source, split), (source), (split), ())")
    sql["hist_num_words"] = f"""WITH {CORPUS} SELECT split,
      len(list_filter(string_split_regex(text, '{WS}+'), lambda x: x <> ''))::BIGINT AS value, count(*) AS n FROM corpus GROUP BY ALL"""
    sql["hist_num_labels"] = f"WITH {ORDERS} SELECT split, len(labels)::BIGINT AS value, count(*) AS n FROM lrows GROUP BY ALL"
    sql["mean_labels"] = f"WITH {ORDERS} SELECT floor(avg(len(labels)))::BIGINT AS mean_labels FROM lrows"
    sql["cooccurrence_pairs"] = f"""WITH {ORDERS} SELECT a.split, a.label AS label_a, b.label AS label_b, count(*) AS n
      FROM long a JOIN long b ON a.row_id = b.row_id AND a.label < b.label GROUP BY ALL"""
    sql["cooccurrence_ratio"] = f"""WITH {ORDERS}, cnt AS (SELECT label, count(*) AS n FROM long GROUP BY label)
      SELECT a.label AS label_i, b.label AS label_j, round(count(*) / any_value(cnt.n)::DOUBLE, 6) AS ratio
      FROM long a JOIN long b ON a.row_id = b.row_id AND a.label <> b.label JOIN cnt ON cnt.label = b.label GROUP BY 1, 2"""
    sql["label_coverage"] = coverage()

    # metrics
    sql["micro_metrics"] = f"""WITH {TWO},
      m AS (SELECT coalesce(t.split, g.split) AS split, t.label IS NOT NULL AS t, g.label IS NOT NULL AS g
            FROM truth t FULL OUTER JOIN guess g ON t.row_id = g.row_id AND t.label = g.label),
      c AS (SELECT split, count(*) FILTER (t AND g) AS tp, count(*) FILTER (g AND NOT t) AS fp,
              count(*) FILTER (t AND NOT g) AS fn FROM m GROUP BY split),
      n AS (SELECT {SPLIT.format('o_orderkey')} AS split, count(*) AS n FROM orders GROUP BY 1),
      f AS (SELECT split, tp, fp, fn, n * (SELECT count(DISTINCT p_brand) FROM part) - tp - fp - fn AS tn FROM c JOIN n USING (split))
      SELECT {scored('f')}"""
    sql["micro_metrics_in_rows"] = f"""WITH {LABELLED},
      classes AS (SELECT unnest(['de', 'en', 'es', 'fr', 'quality', 'toxic']) AS name),
      x AS (SELECT split, list_contains(labels, name) AS t,
              name = 'en' OR (name = 'quality' AND len(list_filter(string_split_regex(text, '{WS}+'), lambda w: w <> '')) > 200) AS g
            FROM labelled CROSS JOIN classes),
      f AS (SELECT split, count(*) FILTER (t AND g) AS tp, count(*) FILTER (g AND NOT t) AS fp,
              count(*) FILTER (t AND NOT g) AS fn, count(*) FILTER (NOT t AND NOT g) AS tn FROM x GROUP BY split)
      SELECT {scored('f')}"""
    sql["threshold_grid"] = f"WITH {CELLS}, {GRID}, r AS (SELECT split, round(threshold, 6) AS threshold, tp, fp, fn, tn FROM grid) SELECT {scored('r')}"
    sql["threshold_grid_fine"] = f"""WITH {CELLS}, g AS (SELECT 0.01::DOUBLE + i * 0.01::DOUBLE AS threshold FROM range(99) t(i)),
      r AS (SELECT round(threshold, 6) AS threshold, {counted('score >= threshold')} FROM cells CROSS JOIN g GROUP BY threshold)
      SELECT {scored('r')}"""
    best = f"(SELECT * FROM (SELECT {scored('total')}) ORDER BY 2 * tp / (2 * tp + fp + fn)::DOUBLE DESC, threshold LIMIT 1)"
    sql["best_threshold"] = f"WITH {CELLS}, {GRID} SELECT * REPLACE (round(threshold, 6) AS threshold) FROM {best}"
    sql["tuned_evaluation"] = f"""WITH {CELLS}, {GRID},
      best AS (SELECT threshold FROM grid WHERE split = 'validation' ORDER BY 2 * tp / (2 * tp + fp + fn)::DOUBLE DESC, threshold LIMIT 1),
      r AS (SELECT split, round(threshold, 6) AS threshold, {counted('score >= threshold')}
            FROM cells CROSS JOIN best WHERE split <> 'validation' GROUP BY split, threshold)
      SELECT {scored('r')}"""
    sql["metrics_by_split"] = f"WITH {CELLS}, r AS (SELECT split, {counted('score >= 0.66')} FROM cells GROUP BY split) SELECT {scored('r')}"
    wide = ", ".join(
        f"max({m}) FILTER (split = '{s}') AS {s}_{m}" for s in ("test", "train", "validation") for m in ("precision", "recall", "f1", "auc_score")
    )
    sql["results_pivot"] = f"WITH {CELLS}, {GRID}, r AS (SELECT {scored('grid')}) SELECT round(threshold, 6) AS threshold, {wide} FROM r GROUP BY threshold"
    sql["topk_baseline"] = f"""WITH {ORDERS},
      ranked AS (SELECT label, row_number() OVER (ORDER BY count(*) DESC, label) AS r FROM long WHERE split = 'train' GROUP BY label),
      v AS (SELECT row_id, label FROM long WHERE split = 'validation'),
      n AS (SELECT count(DISTINCT row_id) AS n, count(*) AS p FROM v),
      ks AS (SELECT unnest(range(51)) AS k),
      u AS (SELECT k, count(r) AS used FROM ks LEFT JOIN ranked ON r <= k AND r <= 50 GROUP BY k),
      h AS (SELECT k, count(v.label) AS tp FROM ks LEFT JOIN ranked ON r <= k AND r <= 50 LEFT JOIN v ON v.label = ranked.label GROUP BY k),
      f AS (SELECT k::INT AS k, tp, n * used - tp AS fp, p - tp AS fn,
              n * (SELECT count(DISTINCT p_brand) FROM part) - n * used - p + tp AS tn FROM u JOIN h USING (k) CROSS JOIN n)
      SELECT {scored('f')}"""
    sql["topk_tuned"] = f"""WITH {ORDERS},
      ranked AS (SELECT label, row_number() OVER (ORDER BY count(*) DESC, label) AS r FROM long WHERE split = 'train' GROUP BY label),
      n AS (SELECT split, count(DISTINCT row_id) AS n, count(*) AS p FROM long GROUP BY split),
      h AS (SELECT split, r, count(*) AS h FROM long JOIN ranked USING (label) GROUP BY ALL),
      u AS (SELECT k, count(r) AS used FROM range(51) t(k) LEFT JOIN ranked ON r <= k GROUP BY k),
      t AS (SELECT n.split, k, used, n, p, coalesce((SELECT sum(h) FROM h WHERE h.split = n.split AND r <= k), 0)::BIGINT AS tp FROM n CROSS JOIN u),
      f AS (SELECT split, k, tp, n * used - tp AS fp, p - tp AS fn,
              n * (SELECT count(DISTINCT label) FROM long) - n * used - p + tp AS tn FROM t),
      best AS (SELECT k FROM f WHERE split = 'validation' ORDER BY 2 * tp / (2 * tp + fp + fn)::DOUBLE DESC, k LIMIT 1),
      g AS (SELECT f.* FROM f JOIN best USING (k)), m AS (SELECT {scored('g')})
      SELECT 'top_k' AS model_name, k, {", ".join(f"max({v}) FILTER (split = '{s}') AS {s}_{v}" for s in ("test", "train") for v in ("precision", "recall", "f1", "auc_score"))}
      FROM m GROUP BY k"""
    sql["topk_per_row"] = f"""WITH {CELLS} SELECT row_id, rank, label_id, round(score, 6) AS score FROM (
      SELECT row_id, label_id, score, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, label_id) AS rank FROM cells)
      WHERE rank <= 3 AND score >= 0.6"""
    sql["topk_search"] = f"""WITH {CELLS},
      ranked AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, label_id) AS r FROM cells),
      ks AS (SELECT unnest(range(1, 11)) AS k),
      seen AS (SELECT k, label_id FROM ks CROSS JOIN ranked WHERE r <= k OR truth = 1 GROUP BY ALL),
      x AS (SELECT k, r <= k AS g, truth = 1 AS t FROM ranked JOIN seen USING (label_id)),
      f AS (SELECT k, count(*) FILTER (t AND g) AS tp, count(*) FILTER (g AND NOT t) AS fp,
              count(*) FILTER (t AND NOT g) AS fn, count(*) FILTER (NOT t AND NOT g) AS tn FROM x GROUP BY k)
      SELECT {scored('f')}"""
    sql["argmax_class"] = f"WITH {CELLS} SELECT row_id, arg_max(label_id, (x, -label_id)) AS class_id FROM cells GROUP BY row_id"
    sql["sigmoid_scores"] = f"WITH {CELLS} SELECT row_id, label_id, round(score, 6) AS score FROM cells"
    sql["binarized"] = f"""WITH {CELLS} SELECT row_id, string_agg((score >= 0.6)::INT::VARCHAR, '' ORDER BY label_id) AS by_prob,
      string_agg((x > 0)::INT::VARCHAR, '' ORDER BY label_id) AS by_logit FROM cells GROUP BY row_id"""
    sql["label_precision"] = f"""WITH {TWO} SELECT g.split, count(t.label) AS n_kept, count(*) AS n_generated,
      round(count(t.label) / count(*)::DOUBLE, 6) AS precision
      FROM (SELECT split FROM truth UNION SELECT split FROM guess) s JOIN guess g ON g.split = s.split
      LEFT JOIN truth t ON t.row_id = g.row_id AND t.label = g.label GROUP BY g.split"""
    sql["latency_summary"] = """SELECT event_type, (user_id % 4)::VARCHAR AS length, count(value) AS num_iter,
      round(avg(value), 6) AS time_avg_ms_per_seq, round(quantile_cont(value, 0.5), 6) AS time_median_ms_per_seq,
      round(stddev_pop(value), 6) AS time_std_ms_per_seq, round(quantile_cont(value, 0.95), 6) AS time_p95_ms_per_seq
      FROM events GROUP BY 1, 2"""
    sql["distinct_rollup"] = f"""WITH {CORPUS}, w AS (SELECT split, source, unnest({LOWER_TOKENS}) AS word FROM corpus)
      SELECT split, source, count(*) AS n_rows, count(DISTINCT word) AS n_exact, true AS close FROM w GROUP BY ROLLUP (split, source)"""
    sql["latency_sketch"] = """SELECT event_type, (user_id % 4)::VARCHAR AS length, count(value) AS num_iter, round(avg(value), 6) AS mean,
      round(stddev_pop(value), 6) AS deviation, true AS median_close, true AS p95_close FROM events GROUP BY 1, 2"""
    weight = " + ".join(f"(d >= {cut})::INT" for cut in K.POISSON)
    sql["mean_intervals"] = f"""WITH b AS (SELECT unnest(range({K.REPLICATES})) AS b),
      d AS (SELECT event_type AS model, value, b, ('0x' || substr(md5('bootstrap:' || b // 4 || ':' || event_id), 8 * (b % 4) + 1, 8))::BIGINT AS d
        FROM events, b WHERE value IS NOT NULL),
      s AS (SELECT model, b, sum(value * ({weight})) AS s, sum({weight}) AS k FROM d GROUP BY 1, 2),
      m AS (SELECT model, list_sort(list(s / k) FILTER (k > 0)) AS m FROM s GROUP BY 1)
      SELECT model, round(avg(value), 6) AS mean, round(any_value(m[greatest(ceil(len(m) * 0.05::DOUBLE), 1)::INT]), 6) AS low,
        round(any_value(m[greatest(ceil(len(m) * 0.95::DOUBLE), 1)::INT]), 6) AS high
      FROM m JOIN events ON event_type = model GROUP BY 1"""
    sql["mean_by_group"] = """SELECT (user_id % 3)::VARCHAR AS device, (user_id % 4)::VARCHAR AS length, event_type AS model,
      round(avg(value), 6) AS mean_value FROM events GROUP BY 1, 2, 3"""
    sql["named_models"] = """SELECT CASE event_type WHEN 'click' THEN 'large' WHEN 'view' THEN 'base' END AS model, count(*) AS n
      FROM events GROUP BY 1"""

    # dedup, filters, resume
    sql["exact_dedup"] = "SELECT min(doc_id) AS row_id, md5(text) AS text_md5 FROM documents GROUP BY text"
    sql["cross_split_dedup"] = f"""WITH {CORPUS} SELECT row_id, split FROM corpus c WHERE text <> '' AND
      (split = 'test'
       OR (split = 'validation' AND text NOT IN (SELECT text FROM corpus WHERE split = 'test'))
       OR (split = 'train' AND text NOT IN (SELECT text FROM corpus WHERE split <> 'train')))"""
    sql["resume_anti"] = f"WITH {CORPUS} SELECT row_id FROM corpus WHERE text NOT IN (SELECT text FROM corpus WHERE split = 'test')"
    sql["filter_valid_labels"] = f"""WITH {ORDERS} SELECT row_id, array_to_string(labels, ',') AS labels FROM lrows
      WHERE len(labels) <= 4 AND NOT list_contains(labels, 'Brand#7')"""
    sql["filter_bucket"] = f"WITH {PARTS}, {TRAIN_BUCKETS} SELECT DISTINCT row_id, bucket FROM long JOIN buckets USING (label)"
    sql["filter_bucket_all"] = f"""WITH {PARTS}, p AS (SELECT * FROM long WHERE label LIKE 'P%'),
      cnt AS (SELECT label, count(*) AS n FROM p GROUP BY label), b AS (SELECT label, {BUCKET} AS bucket FROM cnt)
      SELECT row_id, min(bucket) AS bucket FROM p JOIN b USING (label) GROUP BY row_id HAVING min(bucket) = max(bucket)"""

    # reshape
    sql["bucket_head_tail"] = f"WITH {PARTS}, c AS (SELECT label, count(*) AS n FROM long GROUP BY label) SELECT label, n, {BUCKET} AS bucket FROM c"
    sql["bucket_head_tail_compat"] = f"""WITH {PARTS}, c AS (SELECT label, count(*) AS n FROM long GROUP BY label)
      SELECT label, n, {BUCKET} AS bucket FROM c UNION ALL SELECT label, n, 'tail' FROM c WHERE n >= 100"""
    sql["bucket_freqs"] = f"""WITH {PARTS}, c AS (SELECT label, count(*) AS n FROM long GROUP BY label),
      b AS (SELECT label, n, {BUCKET} AS bucket FROM c)
      SELECT bucket, label AS code, round(n / (sum(n) OVER (PARTITION BY bucket))::DOUBLE, 9) AS freq FROM b"""
    sql["bucket_rows"] = f"""WITH {PARTS}, {TRAIN_BUCKETS} SELECT split, bucket, count(DISTINCT row_id) AS n_rows
      FROM long JOIN buckets USING (label) GROUP BY ALL"""
    sql["upsample"] = f"""WITH {LABELLED}, occ AS (SELECT row_id, unnest(labels) AS label FROM labelled),
      cnt AS (SELECT label, count(*) AS n FROM occ GROUP BY label),
      m AS (SELECT row_id, greatest((SELECT max(n) FROM cnt) // min(n), 1) AS copies FROM occ JOIN cnt USING (label) GROUP BY row_id)
      SELECT row_id, unnest(range(1, coalesce(copies, 1) + 1)) AS copy FROM labelled LEFT JOIN m USING (row_id)"""
    sql["mixture_ratio"] = """WITH t AS (SELECT doc_id AS row_id FROM documents WHERE lang <> 'en'),
      s AS (SELECT doc_id AS row_id, row_number() OVER (ORDER BY doc_id) - 1 AS p FROM documents WHERE lang = 'en'),
      n AS (SELECT (SELECT count(*) FROM t) AS t, (SELECT count(*) FROM s) AS s),
      m AS (SELECT unnest(list_concat([0.0::DOUBLE, 0.5::DOUBLE], list_transform(range(1, ceil(s / t)::BIGINT + 1), lambda i: i::DOUBLE))) AS multiplier, t FROM n)
      SELECT row_id, multiplier FROM t CROSS JOIN m
      UNION ALL SELECT row_id, multiplier FROM s JOIN m ON p < floor(multiplier * t)"""
    sql["split_exact"] = cut_sql("orders", "o_orderkey", "7", "WHEN r <= 1000 THEN 'test'", "validation")
    sql["split_exact_three"] = cut_sql("orders", "o_orderkey", "8", "WHEN r <= 1000 THEN 'test' WHEN r <= 2000 THEN 'validation'", "train")
    sql["split_fraction"] = f"WITH {ORDERS} " + cut_sql(
        "lrows", "row_id", "9",
        "WHEN r <= ceil(ceil(t * 0.2::DOUBLE) / 2) THEN 'test' WHEN r <= ceil(t * 0.2::DOUBLE) THEN 'validation'", "train")
    sql["shuffle_limit"] = f"SELECT o_orderkey, o_custkey FROM orders ORDER BY {hashed('3', 'o_orderkey')}, o_orderkey LIMIT 500"
    sql["first_n"] = "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 100"
    sql["batches"] = "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1024 AS batch_id FROM orders"

    # text
    sql["clean_text"] = f"SELECT doc_id AS row_id, {rewrite('text', CLEAN)} AS text FROM documents"
    sql["normalize_nfkd"] = f"SELECT doc_id AS row_id, {rewrite(nfkd('lower(text)'), FEATURE)} AS text FROM documents"
    sql["normalize_nfkc"] = f"SELECT doc_id AS row_id, {BAG_TEXT} AS text FROM documents"
    tokens = "SELECT doc_id AS row_id, len(t)::BIGINT AS n, array_to_string(t, ' ') AS tokens FROM (SELECT doc_id, {0} AS t FROM documents)"
    sql["tokenize"] = tokens.format(TOKENS.format("text"))
    sql["stopwords"] = tokens.format(f"list_filter({LOWER_TOKENS}, lambda w: NOT list_contains({STOP}, w))")
    sql["analyze_text"] = tokens.format(
        f"list_transform(list_filter({TOKENS.format(BAG_TEXT)}, lambda w: NOT list_contains({STOP}, w)), lambda w: {STEM.format('w')})")
    sql["stem_terms"] = f"""SELECT row_id, {STEM.format('term')} AS term, count(*) AS tf
      FROM (SELECT doc_id AS row_id, unnest({LOWER_TOKENS}) AS term FROM documents) GROUP BY 1, 2"""
    sql["french_stems"] = f"""WITH t AS (SELECT doc_id AS row_id, unnest({LOWER_TOKENS}) AS term FROM documents WHERE lang = 'fr')
      SELECT row_id, count(*) AS n_words, count(DISTINCT term) AS n_terms, true AS merged, true AS shorter FROM t GROUP BY 1"""
    sql["labelled_line"] = f"""WITH {LABELLED} SELECT row_id,
      array_to_string(list_transform(labels, lambda l: '__label__' || l), ' ') || ' ' || {BAG_TEXT} AS line FROM labelled"""
    sql["parse_labelled_line"] = f"""WITH {LABELLED} SELECT row_id,
      array_to_string(list_transform(labels, lambda l: '__label__' || l), ' ') AS labels, text FROM labelled"""
    sql["split_slug"] = """SELECT doc_id AS row_id, source || '.test.' || upper(lang) AS split_name,
      '/data/my_set/' || source || '_test_' || lang || '.jsonl' AS slug FROM documents"""
    sql["remove_newlines"] = "SELECT doc_id AS row_id, replace(text, chr(10), '') AS text FROM documents"
    sql["concat_texts"] = """SELECT event_id, coalesce(event_type, '') || ' | ' || coalesce(value::DECIMAL(18, 4)::VARCHAR, '') || ' | ' ||
      coalesce(props, '') AS text FROM events"""
    sql["corpus_from_tokens"] = f"""SELECT * FROM (SELECT doc_id AS row_id, md5(text) AS raw_md5, {rewrite('text', CLEAN)} AS text,
      (len(list_filter(string_split(text, ' '), lambda w: length(w) > 14)) > 0)::BIGINT AS has_diso FROM documents) WHERE text <> ''"""
    sql["parse_answers"] = f"""WITH {ORDERS}, {ANSWERS} SELECT row_id, len(labels)::BIGINT AS n,
      array_to_string(labels, '|') AS labels FROM parsed WHERE n_parts = 2"""
    sql["rejected_answers"] = f"WITH {ORDERS}, {ANSWERS} SELECT row_id, md5(output) AS output_md5 FROM parsed WHERE coalesce(n_parts, 0) <> 2"

    # prompts
    context = "(SELECT string_agg(code || ': ' || description, chr(10) ORDER BY ord) FROM brands)"
    prompt = "'## Codes' || chr(10) || chr(10) || {0} || chr(10) || chr(10) || '## Format' || chr(10) || chr(10) || '{{codes}}' || chr(10) || chr(10) || '## Text' || chr(10) || chr(10) || text"
    prompt = prompt.format(context)
    sql["prompt_context"] = f"WITH {BRANDS} SELECT doc_id AS row_id, {prompt} AS pre_query_str FROM documents"
    lines = """lines AS (SELECT row_id, string_agg(label || ': ' || description, chr(10) ORDER BY label) AS label_lines
      FROM long JOIN brands ON code = label GROUP BY row_id)"""
    sql["code_lookup"] = f"WITH {ORDERS}, {BRANDS}, {lines} SELECT row_id, label_lines FROM lines"
    sql["prompt_fill"] = f"""WITH {ORDERS}, {BRANDS}, {lines} SELECT row_id, '## Text' || chr(10) || chr(10) || source || ' {{labels}}' ||
      chr(10) || chr(10) || '## Codes' || chr(10) || chr(10) || label_lines AS pre_query_str FROM lines JOIN heads USING (row_id)"""
    sql["weighted_sample"] = f"WITH RECURSIVE {ORDERS}, {SAMPLED} SELECT row_id, pos, code FROM sampled"
    sql["prompt_sample"] = f"""SELECT row_id, types, styles FROM ({items(TYPES, 'types')}) JOIN ({items(STYLES, 'styles')}) USING (row_id)"""
    sql["uniform_count"] = f"SELECT doc_id AS row_id, 1 + {to_int(hashed('4', 'doc_id'))} % 5 AS n FROM documents"
    filled = """'Types:' || chr(10) || chr(10) || types || chr(10) || chr(10) || 'Styles:' || chr(10) || chr(10) || styles ||
      chr(10) || chr(10) || '## Codes' || chr(10) || chr(10) || label_lines"""
    sql["synthetic_prompts"] = f"""WITH RECURSIVE {ORDERS}, {SAMPLED}, {BRANDS},
      l AS (SELECT row_id, string_agg(code, ',' ORDER BY pos) AS labels, string_agg(code || ': ' || description, chr(10) ORDER BY pos) AS label_lines
            FROM sampled JOIN brands USING (code) GROUP BY row_id)
      SELECT row_id, labels, {filled} AS pre_query_str FROM l
      JOIN ({items(TYPES, 'types').replace("':', '6'", "':', '5'")}) USING (row_id)
      JOIN ({items(STYLES, 'styles').replace("':', '6'", "':', '5'")}) USING (row_id)"""

    # features
    terms = f"terms AS (SELECT row_id, split, term, count(*) AS tf FROM (SELECT row_id, split, unnest({LOWER_TOKENS}) AS term FROM corpus) GROUP BY ALL)"
    sql["doc_freq"] = f"WITH {CORPUS}, {terms} SELECT term, count(*) AS n_docs FROM terms WHERE split = 'train' GROUP BY term"
    sql["tfidf"] = f"""WITH {CORPUS}, {terms},
      d AS (SELECT term, ln((1 + (SELECT count(*) FROM corpus WHERE split = 'train')) / (1 + count(*))::DOUBLE) + 1 AS idf
            FROM terms WHERE split = 'train' GROUP BY term),
      w AS (SELECT row_id, term, tf * idf AS raw FROM terms JOIN d USING (term))
      SELECT row_id, term, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY row_id)), 6) AS weight FROM w"""
    sql["tfidf_features"] = f"""WITH {VECTORS}
      SELECT row_id, term, index, n_docs, round(v, 6) AS weight FROM x JOIN vocabulary USING (term)"""
    for kind in ("lr", "svm"):
        sql[f"ovr_{kind}"] = f"WITH {VECTORS}, {linear_steps(kind, 10.0, 3)}, r AS ({linear_counts()}) SELECT {scored('r')}"
    sql["word_ngrams"] = f"""WITH t AS (SELECT {LOWER_TOKENS} AS ws FROM documents),
      g AS (SELECT ws, i, n FROM (SELECT ws, unnest(range(1, len(ws) + 1)) AS i FROM t) CROSS JOIN (SELECT unnest([1, 2, 3]) AS n))
      SELECT array_to_string(ws[i:i + n - 1], ' ') AS gram, count(*) AS n FROM g WHERE i + n - 1 <= len(ws) GROUP BY 1"""
    sql["char_ngrams"] = f"""WITH t AS (SELECT '<' || unnest({LOWER_TOKENS}) || '>' AS w FROM documents),
      c AS (SELECT w, count(*) AS m FROM t GROUP BY w),
      g AS (SELECT w, m, unnest(range(1, length(w) + 1)) AS i FROM c)
      SELECT substr(w, i, k) AS gram, sum(m)::BIGINT AS n FROM g CROSS JOIN (SELECT unnest([3, 4, 5, 6]) AS k)
      WHERE i + k - 1 <= length(w) GROUP BY 1"""

    sql["hashed_ngrams"] = f"""WITH t AS (SELECT doc_id AS row_id, {LOWER_TOKENS} AS ws FROM documents),
      w AS (SELECT row_id, ws, i, n FROM (SELECT row_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM t) CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS n)),
      c AS (SELECT row_id, w, unnest(range(1, length(w) + 1)) AS i FROM (SELECT row_id, '<' || unnest(ws) || '>' AS w FROM t)),
      g AS (SELECT row_id, array_to_string(ws[i:i + n - 1], ' ') AS gram FROM w WHERE i + n - 1 <= len(ws)
        UNION ALL SELECT row_id, substr(w, i, k) FROM c CROSS JOIN (SELECT unnest([3, 4, 5, 6]) AS k) WHERE i + k - 1 <= length(w))
      SELECT ('0x' || substr(md5(gram), 1, 8))::BIGINT % {X.BUCKETS} AS bucket, count(DISTINCT row_id) AS n_docs, count(*) AS n FROM g GROUP BY 1"""

    # fitted models: what the rows say themselves, and that the fit beats the most frequent label
    facts = f"""WITH {LABELLED}, top AS (SELECT label FROM (SELECT unnest(labels) AS label FROM labelled WHERE split = 'train')
        GROUP BY 1 ORDER BY count(*) DESC, label LIMIT 1),
      f AS (SELECT split, count(*) AS n, sum(len(labels))::BIGINT AS n_true, count_if(list_contains(labels, (SELECT label FROM top))) AS tp
        FROM labelled GROUP BY split),
      facts AS (SELECT split, n_true, n * {len(Q.DOC_LABELS)} AS n_cells, round(2 * tp / (n + n_true)::DOUBLE, 6) AS baseline, true AS better FROM f)"""
    sql["ngram_classifier"] = f"{facts} SELECT * FROM facts"
    sql["ovr_tuned"] = f"{facts} SELECT 'tfidf_lr' AS model_name, * FROM facts WHERE split IN ('train', 'test')"
    sql["param_grid"] = f"""{facts} SELECT kind, c, true AS within, * FROM facts, (SELECT unnest(['lr', 'svm']) AS kind),
      (SELECT unnest({Q.GRID_C}::DOUBLE[]) AS c) WHERE split = 'validation'"""
    sql["ratio_search"] = f"""{facts}, n AS (SELECT count_if(NOT list_contains(labels, 'en')) AS t, count_if(list_contains(labels, 'en')) AS s
        FROM labelled WHERE split = 'train'),
      m AS (SELECT unnest(list_concat([0.0::DOUBLE, 0.5::DOUBLE], list_transform(range(1, ceil(s / t)::BIGINT + 1), lambda i: i::DOUBLE))) AS multiplier FROM n)
      SELECT multiplier, n_true, n_cells, baseline FROM facts, m WHERE split = 'validation'"""

    # weights and losses
    sql["class_counts"] = f"WITH {CLASSES} SELECT label_id, n FROM pos"
    for name, column in (("weights_pos", "w_pos"), ("weights_inv_sqrt", "w_inv"), ("weights_cb", "w_cb")):
        sql[name] = f"WITH {CLASSES} SELECT label_id, round({column}, 6) AS weight FROM weights"
    sql["ntr_bias"] = f"WITH {CLASSES} SELECT label_id, round(bias, 6) AS bias FROM weights"
    sql["start_bias"] = f"WITH {CLASSES} SELECT label_id, round(-ln((1 - 1 / c::DOUBLE) * c), 6) AS bias FROM (SELECT label_id, count(*) OVER () AS c FROM pos)"
    for name, value in LOSSES.items():
        sql["loss_" + name.replace("-", "_")] = f"""WITH {CELLS}, {CLASSES}
          SELECT round(avg({value}), 6) AS loss FROM cells JOIN weights USING (label_id)"""
    sql["distil_loss"] = f"""WITH {CELLS},
      p AS (SELECT x, truth, 1 / (1 + exp(-(x * 0.5 + truth * 2) / 2)) AS p, -ln(1 + exp(-x / 2)) AS q FROM cells),
      s AS (SELECT avg(p * ln(p) - p * q) * 4 AS kl, avg({_bce('x')}) AS hard FROM p)
      SELECT round(kl, 6) AS kl, round(hard, 6) AS hard, round(0.7::DOUBLE * hard + 0.3::DOUBLE * kl, 6) AS loss FROM s"""

    # sources and sinks
    sql["jsonl_ordered"] = """SELECT row_number() OVER (ORDER BY list_position(['fr', 'de', 'es', 'en'], lang), doc_id) - 1 AS ord, md5(text) AS text_md5
      FROM documents"""
    sql["named_splits"] = """SELECT CASE WHEN lang IN ('en', 'es') THEN 'train' WHEN lang = 'fr' THEN 'test_test.a' ELSE 'test_test.b' END AS split, lang, count(*) AS n
      FROM documents GROUP BY ALL"""
    sql["csv_roundtrip"] = """SELECT o_orderpriority || ', "' || o_orderstatus || '"' AS text, o_orderstatus AS label, count(*) AS n
      FROM orders GROUP BY ALL"""
    sql["labelled_lines_file"] = f"""WITH {LABELLED} SELECT array_to_string(list_transform(labels, lambda l: '__label__' || l), ' ') AS labels,
      count(*) AS n, sum(length({BAG_TEXT}))::BIGINT AS n_chars FROM labelled GROUP BY 1"""
    sql["labelled_lines_format"] = sql["labelled_lines_file"]
    sql["replaced_table"] = """SELECT version, o_orderstatus, count(*) AS n, sum(o_orderkey)::BIGINT AS keys
      FROM orders, (SELECT unnest(['old', 'new']) AS version) WHERE version = 'old' OR o_orderstatus <> 'O' GROUP BY ALL"""
    sql["tokenised_source"] = f"""WITH t AS (SELECT lang AS source, {SPLIT.format('doc_id')} AS split, string_split(text, ' ') AS ws FROM documents)
      SELECT source, split, count(*) AS n, sum(len(ws))::BIGINT AS n_tokens,
        sum(list_sum(list_transform(ws, lambda w: length(w) % 4)))::BIGINT AS tags FROM t GROUP BY ALL"""
    sql["dictionary_file"] = f"""WITH {ORDERS} SELECT code, description, row_number() OVER (ORDER BY code) - 1 AS n
        FROM (SELECT 'P' || p_partkey AS code, p_name AS description FROM part)
      UNION ALL SELECT label, '', count(*) FROM long GROUP BY label"""
    sql["template_file"] = """SELECT doc_id AS row_id, md5('## Text' || chr(10) || chr(10) || text || chr(10) || chr(10) || '## Codes' || chr(10) || chr(10) || lang) AS prompt_md5
      FROM documents"""
    sql["selected_rows"] = f"""WITH {CORPUS} SELECT row_id, source AS origin, split, 1::INT AS has_diso FROM corpus
      WHERE split <> 'validation' AND source LIKE 'src1%'"""
    sql["generation_settings"] = """SELECT doc_id AS row_id, substr(text, 1, 40) AS prompt, 0.5::DOUBLE AS temperature, 1::DOUBLE AS top_p,
      1::DOUBLE AS repetition_penalty, 64::INT AS max_tokens, 'stub' AS model, (SELECT count(*) FROM documents) AS n_rows FROM documents"""
    sql["appended_rows"] = "SELECT event_id, epoch_us(ts) AS ts, event_type FROM events"
    pivot = ", ".join(
        f"max({m}) FILTER (split = '{s}') AS {s}_{m}" for s in ("test", "train") for m in ("precision", "recall", "f1", "auc_score", "threshold")
    )
    sql["gathered_results"] = f"""WITH {CELLS}, r AS (SELECT split, {counted('score >= 0.66')} FROM cells GROUP BY split),
      s AS (SELECT {scored('(SELECT *, 0.66::DOUBLE AS threshold FROM r)')}) SELECT 'student' AS model_name, {pivot} FROM s"""
    sql["sentences_by_length"] = """SELECT conv_id, turn, role AS length, unnest([0, 1])::BIGINT AS pos, unnest([text, role]) AS sentence
      FROM conversations"""
    sql["regression_labels"] = "SELECT event_id, round(value::FLOAT::DOUBLE, 2) AS label FROM events"

    # inference
    sql["batch_infer"] = f"""SELECT doc_id AS row_id, c AS label_id, round(((length(text) * (c + 3)) % 97) / 97.0::DOUBLE, 6) AS score
      FROM documents CROSS JOIN (SELECT unnest(range({Q.N_PROB_CLASSES})) AS c)"""
    sql["generated_labels"] = f"""WITH {BRANDS}, g AS (SELECT doc_id AS row_id, 'Brand#' || length({prompt}) % 30 AS labels FROM documents)
      SELECT row_id, labels FROM g JOIN brands ON code = labels"""
    sql["annotate_stream"] = """SELECT doc_id, md5('### Analysis' || chr(10) || chr(10) || length(text) || chr(10) || chr(10) || '### Result' ||
      chr(10) || chr(10) || 'Brand#' || length(text) % 30) AS output_md5 FROM documents d
      WHERE NOT EXISTS (FROM documents e WHERE e.text = d.text AND e.doc_id % 3 < d.doc_id % 3)"""
    sql["first_arrivals"] = """SELECT min_by(event_id, (ts, event_id)) AS event_id, text
      FROM (SELECT *, event_type || ' ' || user_id % 50 AS text FROM events) GROUP BY text"""
    sql["stream_dedup"] = "SELECT DISTINCT md5(text) AS text_md5 FROM documents"
    return sql
