"""SQL fragments shared by the check queries."""

from __future__ import annotations

# Fixed values, spelled out here so that a wrong character in the code shows.
BASE_PROMPT = "Write a recipe for the following dish: "
ADVERTISEMENT = "ADVERTISEMENT"
DROPPED_PHRASES = ("Watch how to make this recipe.",)
HTML_ELEMENT = r"<[^>]+>[^\n]*?</[^>]+>"
ALLOWED_CHARACTERS = (
    "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    " .,/:;'\"[]{}+=-_\u2013()*&^%$#@!~\\|\u00b0<>?"
)
WHITESPACE = (
    9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, 8192, 8193, 8194, 8195, 8196, 8197,
    8198, 8199, 8200, 8201, 8202, 8232, 8233, 8239, 8287, 12288,
)
WHITESPACE_CLASS = "[" + "".join(f"\\x{{{code:x}}}" for code in WHITESPACE) + "]"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


BLANKS = "concat(" + ", ".join(f"chr({code})" for code in WHITESPACE) + ")"


def strip(c: str) -> str:
    return f"trim({c}, {BLANKS})"


def accents(c: str) -> str:
    return f"strip_accents({c})"


def advertisement(c: str) -> str:
    return strip(f"replace({c}, '{ADVERTISEMENT}', '')")


def whitespace(c: str) -> str:
    joined = f"replace(replace({c}, chr(10), ''), chr(9), '')"
    return strip(f"regexp_replace({joined}, '{WHITESPACE_CLASS}+', ' ', 'g')")


def phrases(c: str) -> str:
    for phrase in DROPPED_PHRASES:
        c = f"replace({c}, {quoted(phrase)}, '')"
    return c


def html(c: str) -> str:
    return f"regexp_replace({c}, {quoted(HTML_ELEMENT)}, '', 'g')"


DISALLOWED = "[^" + "".join("\\" + c if c in "[]-\\^" else c for c in ALLOWED_CHARACTERS) + "]"


def special(c: str) -> str:
    return f"regexp_replace({c}, {quoted(DISALLOWED)}, '', 'g')"


def clean_text(c: str) -> str:
    return whitespace(html(phrases(special(accents(c)))))


def clean_list(c: str) -> str:
    kept = f"list_filter(list_transform({c}, lambda x: {advertisement('x')}), lambda x: x <> '')"
    return f"list_transform({kept}, lambda x: {whitespace(special(html(phrases(accents('x')))))})"


def words(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]+')"


def rendered(title: str = "title", items: str = "ingredients", steps: str = "instructions") -> str:
    nl = "chr(10)"
    listed = f"array_to_string(list_transform({items}, lambda x: '- ' || x), {nl})"
    return (
        f"('Title: ' || {title} || {nl} || {nl} || 'Ingredients:' || {nl} || {listed}"
        f" || {nl} || {nl} || 'Instructions: ' || {steps})"
    )


def joined(items: str) -> str:
    return f"array_to_string({items}, ' ')"


RECIPES = """recipes AS (
  SELECT doc_id + 1 AS id, source, regexp_extract(text, '^[^\\n.]*') AS title,
         string_split(text, chr(10)) AS ingredients, text AS instructions
  FROM documents)"""

FINETUNE_TEXT = f"('{BASE_PROMPT} ' || title || chr(10) || chr(10) || {rendered()})"

EXAMPLES = f"""{RECIPES}, examples AS (
  SELECT ex_id, text, words, len(words) AS length FROM (
    SELECT id AS ex_id, {FINETUNE_TEXT} AS text, {words(FINETUNE_TEXT)} AS words FROM recipes)
  )"""

SHUFFLED = f"""{EXAMPLES}, shuffled AS (
  SELECT ex_id, length, md5('42:' || ex_id) AS h,
         row_number() OVER (ORDER BY md5('42:' || ex_id), ex_id) AS position,
         count(*) OVER () AS n
  FROM examples), split AS (
  SELECT *, CASE WHEN position <= floor(n * 0.9::DOUBLE) THEN 'train' ELSE 'val' END AS split
  FROM shuffled)"""

GROUPED = f"""{SHUFFLED}, grouped AS (
  SELECT ex_id, length, length_rank, (length_rank - 1) // 6 AS group_id FROM (
    SELECT ex_id, length, row_number() OVER (ORDER BY length, position) AS length_rank
    FROM split WHERE split = 'train'))"""

BATCHED = f"""{GROUPED}, batched AS (
  SELECT ex_id, length, group_id, p AS train_position, (p - 1) // 6 AS batch_id,
         ((p - 1) % 6)::INT AS pos_in_batch
  FROM (SELECT *, row_number() OVER (ORDER BY md5('42:' || group_id), group_id, length_rank) AS p
        FROM grouped))"""


def vocabulary(docs: str = "documents", key: str = "doc_id", min_count: int = 1, most: int = 2**31 - 3) -> str:
    """CTEs: places(key, pos, word), vocab(word, n, id) and encoded(key, ids)."""
    return f"""places AS (
  SELECT {key}, unnest({words('text')}) AS word, generate_subscripts({words('text')}, 1) AS pos
  FROM {docs}), vocab AS (
  SELECT word, n, (row_number() OVER (ORDER BY n DESC, word) - 1)::INT AS id FROM (
    SELECT word, count(*) AS n FROM places GROUP BY word HAVING count(*) >= {min_count}) QUALIFY id < {most}
), size AS (SELECT count(*)::INT AS v FROM vocab), encoded AS (
  SELECT d.{key}, coalesce(ids, []::INT[]) AS ids FROM {docs} d LEFT JOIN (
    SELECT {key}, list(coalesce(id, (SELECT v + 1 FROM size)) ORDER BY pos) AS ids
    FROM places LEFT JOIN vocab USING (word) GROUP BY {key}) e ON e.{key} = d.{key})"""


def ended(key: str = "doc_id", max_length: int | None = None) -> str:
    """CTE after ``vocabulary``: ended(key, ids) with the end token, perhaps cut to length."""
    ids = "list_append(ids, (SELECT v FROM size))"
    ids = ids if max_length is None else f"list_slice({ids}, 1, {max_length})"
    return f"ended AS (SELECT {key}, {ids} AS ids FROM encoded)"


DICTIONARY = f"""dictionary AS (
  SELECT word FROM (SELECT doc_id, unnest(list_distinct({words('text')})) AS word FROM documents)
  GROUP BY word HAVING count(*) >= 5)"""

STEPS = """steps AS (
  SELECT event_id AS step, value AS loss_sum, user_id % 2 AS correct, 1 AS total FROM events)"""

METRICS = """metrics AS (
  SELECT event_id AS step, CASE WHEN event_id % 5 = 0 THEN 'val' ELSE 'train' END AS phase,
         value AS loss, user_id / 1000 AS accuracy,
         CASE WHEN event_id % 5 <> 0 THEN 0.0004::DOUBLE END AS learning_rate
  FROM events)"""

LOGITS = """logit_rows AS (
  SELECT vec_id AS ctx_id, embedding AS logits,
         CASE WHEN vec_id % 10 = 0 THEN -100 ELSE label END AS label
  FROM embeddings)"""

GENERATIONS = """generations AS (
  SELECT a.turn::INT AS step, a.conv_id::INT AS prompt_id, coalesce(q.text, '') AS input,
         a.text AS output
  FROM conversations a LEFT JOIN conversations q ON q.conv_id = a.conv_id AND q.turn + 1 = a.turn
  WHERE a.role = 'assistant')"""


def diversity(c: str, n: int = 3) -> str:
    return f"""(SELECT CASE WHEN len(w) < {n} THEN 0.0 ELSE
      len(list_distinct(list_transform(range(1, len(w) - {n} + 2),
        lambda i: array_to_string(list_slice(w, i, i + {n} - 1), ' '))))::DOUBLE
      / greatest(len(w) - {n} + 1, 1) END FROM (SELECT {words(c)} AS w))"""


def self_bleu(rows: str, group: str, id: str, text: str) -> str:
    """CTE bleu(group, texts, self_bleu) over ``rows``."""
    grams = " UNION ALL ".join(
        f"SELECT g, i, {n} AS n, unnest(list_transform(range(1, len(w) - {n} + 2), "
        f"lambda k: array_to_string(list_slice(w, k, k + {n} - 1), ' '))) AS gram "
        f"FROM bleu_texts WHERE len(w) >= {n}"
        for n in range(1, 5)
    )
    return f"""bleu_texts AS (
  SELECT {group} AS g, {id} AS i, {words(text)} AS w FROM {rows}), bleu_counts AS (
  SELECT g, i, n, gram, count(*) AS c FROM ({grams}) GROUP BY ALL), bleu_others AS (
  SELECT a.*, max(c) OVER (PARTITION BY g, n, gram ORDER BY c DESC, i
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
         max(c) OVER (PARTITION BY g, n, gram ORDER BY c DESC, i
           ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after
  FROM bleu_counts a), bleu_hits AS (
  SELECT g, i, n, sum(least(c, greatest(coalesce(before, 0), coalesce(after, 0)))) AS hits
  FROM bleu_others GROUP BY ALL), bleu_reference AS (
  SELECT a.g, a.i, arg_min(len(b.w), abs(len(b.w) - len(a.w)) * 1000000 + len(b.w)) AS ref
  FROM bleu_texts a JOIN bleu_texts b ON a.g = b.g AND a.i <> b.i GROUP BY a.g, a.i
), bleu_scores AS (
  SELECT t.g, t.i, CASE WHEN len(any_value(w)) = 0
      OR coalesce(max(CASE WHEN k.n = 1 THEN hits END), 0) = 0 THEN 0.0
    ELSE (CASE WHEN len(any_value(w)) > any_value(ref) THEN 1.0
          ELSE exp(1 - any_value(ref)::DOUBLE / len(any_value(w))) END)
      * exp(sum(ln((CASE WHEN coalesce(hits, 0) = 0 THEN 0.1 ELSE hits END)::DOUBLE
                   / greatest(len(w) - k.n + 1, 1))) / 4) END AS bleu
  FROM bleu_texts t CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS n) k
  LEFT JOIN bleu_hits h ON h.g = t.g AND h.i = t.i AND h.n = k.n
  LEFT JOIN bleu_reference r ON r.g = t.g AND r.i = t.i
  GROUP BY t.g, t.i), bleu AS (
  SELECT g, count(*) AS texts, CASE WHEN count(*) < 2 THEN 0.0 ELSE avg(bleu) END AS self_bleu
  FROM bleu_scores GROUP BY g)"""
