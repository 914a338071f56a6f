"""Queries: losses, text metrics, logs, sampling and completion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import assembly, generation, logs, metrics, tokens
from millrace.plans import sql, views
from millrace.plans.corpus_queries import VOCAB
from millrace.plans.registry import query
from millrace.sources import tables
from millrace.sources.scratch import cut_lineage, new_folder


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


LOSSES = f"""{sql.LOGITS}, losses AS (
  SELECT label, CASE WHEN label <> -100 THEN top + ln(list_sum(
      list_transform(logits, lambda x: exp(x::DOUBLE - top)))) - logits[label + 1]::DOUBLE END AS loss,
    label <> -100 AND list_position(logits, list_max(logits)) - 1 = label AS hit
  FROM (SELECT *, list_max(logits)::DOUBLE AS top FROM logit_rows))"""


@query(
    f"""WITH {LOSSES} SELECT label, round(coalesce(sum(loss), 0), 6) AS loss_sum,
      count(*) FILTER (WHERE hit) AS correct, count(*) FILTER (WHERE label <> -100) AS total
    FROM losses GROUP BY label"""
)
def masked_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = metrics.masked_cross_entropy(views.logit_rows(spark, sf_dir), by=["label"])
    return rounded(sums, "loss_sum")


def summary(source: str) -> str:
    return f"""SELECT *, exp(least(loss, 20)) AS perplexity FROM (
      SELECT *, loss_sum / total AS loss, correct::DOUBLE / total AS accuracy FROM {source})"""


def summary_columns(*first: str) -> str:
    return ", ".join(
        [*first, *[f"round({c}, 6) AS {c}" for c in ("loss_sum", "loss", "accuracy")],
         "round(perplexity, 3) AS perplexity",
         "correct::BIGINT AS correct", "total::BIGINT AS total"]
    )


def summary_rows(df: DataFrame) -> DataFrame:
    # Perplexities reach exp(20): six decimals would be finer than a double.
    shown = rounded(df, "loss_sum", "loss", "accuracy")
    return shown.withColumn("perplexity", F.round("perplexity", 3))


@query(
    f"""WITH {LOSSES}, sums AS (
      SELECT sum(loss) AS loss_sum, count(*) FILTER (WHERE hit) AS correct,
             count(*) FILTER (WHERE label <> -100) AS total FROM losses)
    SELECT {summary_columns()} FROM ({summary('sums')})"""
)
def loss_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = metrics.masked_cross_entropy(views.logit_rows(spark, sf_dir))
    return summary_rows(metrics.loss_summary(sums))


def windows(kept: str = "true") -> str:
    return f"""WITH {sql.STEPS}, sums AS (
      SELECT max(step) + 1 AS step, sum(loss_sum) AS loss_sum, sum(correct) AS correct, sum(total) AS total
      FROM steps WHERE {kept} GROUP BY step // 16 HAVING max(step) % 16 = 15)
    SELECT {summary_columns('step')} FROM ({summary('sums')})"""


@query(windows())
def accumulate_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.steps(views.table(spark, sf_dir, "events"))
    return summary_rows(metrics.accumulate_windows(rows, 16))


@query(
    f"""WITH {sql.STEPS}, sums AS (
      SELECT sum(loss_sum) AS loss_sum, sum(correct) AS correct, sum(total) AS total
      FROM steps WHERE step < 800) SELECT {summary_columns()} FROM ({summary('sums')})"""
)
def evaluate_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.steps(views.table(spark, sf_dir, "events"))
    return summary_rows(metrics.evaluate_first(rows, 800))


@query(f"SELECT doc_id, round({sql.diversity('text')}, 6)::DOUBLE AS diversity FROM documents")
def ngram_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    diversity = metrics.text_diversity(F.col("text"))
    return views.corpus(spark, sf_dir).select("doc_id", F.round(diversity, 6).alias("diversity"))


REPLIES = "replies AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant')"


@query(
    f"""WITH {REPLIES}, {sql.self_bleu('replies', 'conv_id', 'turn', 'text')}
    SELECT g AS conv_id, texts, round(self_bleu, 6)::DOUBLE AS self_bleu FROM bleu"""
)
def self_bleu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.self_bleu(views.replies(spark, sf_dir), ["conv_id"], "turn"), "self_bleu")


def validity(rows: str, key: str, text: str) -> str:
    return f"""SELECT {key}, CASE WHEN count(word) = 0 THEN 0.0
      ELSE (count(*) FILTER (WHERE word IN (SELECT word FROM dictionary)))::DOUBLE / count(word)
      END AS lexical_validity
    FROM (SELECT {key}, unnest(CASE WHEN len(w) = 0 THEN [NULL] ELSE w END) AS word
      FROM (SELECT {key}, {sql.words(text)} AS w FROM {rows})) GROUP BY {key}"""


@query(
    f"""WITH {sql.DICTIONARY} SELECT doc_id, round(lexical_validity, 6)::DOUBLE AS lexical_validity
    FROM ({validity('documents', 'doc_id', 'text')})"""
)
def lexical_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = views.dictionary(spark, sf_dir)
    scored = metrics.lexical_validity(views.corpus(spark, sf_dir), words, ["doc_id"])
    return rounded(scored, "lexical_validity")


SCORED = f"""{sql.GENERATIONS}, {sql.DICTIONARY}, validity AS (
  {validity('generations', 'step, prompt_id', 'output')}), scored AS (
  SELECT g.*, {sql.diversity('output')} AS diversity, lexical_validity
  FROM generations g JOIN validity USING (step, prompt_id)),
{sql.self_bleu('generations', 'step', 'prompt_id', 'output')}, summary AS (
  SELECT step, avg(diversity) AS avg_diversity, avg(lexical_validity) AS avg_lexical_validity,
         any_value(self_bleu) AS self_bleu
  FROM scored JOIN bleu ON bleu.g = step GROUP BY step)"""
SUMMARY = """step, round(avg_diversity, 6)::DOUBLE AS avg_diversity,
  round(avg_lexical_validity, 6)::DOUBLE AS avg_lexical_validity, round(self_bleu, 6)::DOUBLE AS self_bleu"""


@query(f"WITH {SCORED} SELECT {SUMMARY} FROM summary")
def checkpoint_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.generations(spark, sf_dir)
    words = views.dictionary(spark, sf_dir)
    result = metrics.checkpoint_summary(rows, rows, words, sample_id="prompt_id")
    return rounded(result, "avg_diversity", "avg_lexical_validity", "self_bleu")


@query(
    """SELECT event_id AS step, round(CASE WHEN event_id < 300 THEN event_id / 300
      WHEN event_id >= 300 THEN greatest(0.1::DOUBLE, 0.5::DOUBLE * (1 + cos(pi() * (event_id - 300) / 2700)))
      ELSE 1.0 END, 6)::DOUBLE AS multiplier FROM events"""
)
def lr_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    multiplier = metrics.lr_schedule(F.col("event_id"), 300, 300, 2700)
    return views.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("step"), F.round(multiplier, 6).alias("multiplier")
    )


def metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.metric_rows(views.table(spark, sf_dir, "events"))


@query(
    f"""WITH {sql.METRICS} SELECT step, phase, loss, accuracy, NULL::DOUBLE AS perplexity,
      learning_rate, NULL::DOUBLE AS grad_norm FROM metrics"""
)
def append_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train and validation rows appended to one log and read back."""
    path = new_folder(spark, "metrics")
    rows = metric_rows(spark, sf_dir)
    tables.append_metrics(rows.where("phase = 'train'"), path)
    tables.append_metrics(rows.where("phase = 'val'").drop("learning_rate"), path)
    return tables.read_metrics(spark, path)


@query(
    f"""WITH finished AS ({windows()}) SELECT step, 'train' AS phase, loss, accuracy,
      round(CASE WHEN step < 300 THEN step / 300
        ELSE greatest(0.1::DOUBLE, 0.5::DOUBLE * (1 + cos(pi() * (step - 300) / 2700))) END * 0.0004, 9)::DOUBLE
        AS learning_rate FROM finished"""
)
def training_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished windows with their learning rate, appended to the log and read back."""
    path = new_folder(spark, "metrics")
    finished = metrics.accumulate_windows(views.steps(views.table(spark, sf_dir, "events")), 16)
    rate = metrics.lr_schedule(F.col("step"), 300, 300, 2700) * 0.0004
    rows = finished.withColumns({"phase": F.lit("train"), "learning_rate": rate})
    tables.append_metrics(rows, path)
    logged = tables.read_metrics(spark, path)
    shown = rounded(logged, "loss", "accuracy").withColumn("learning_rate", F.round("learning_rate", 9))
    return shown.select("step", "phase", "loss", "accuracy", "learning_rate")


@query(f"WITH {sql.METRICS} SELECT step, phase, loss, accuracy FROM metrics WHERE step <= 5000")
def truncate_for_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows after the resume step dropped from a stored log, in place."""
    path = new_folder(spark, "metrics")
    tables.replace_table(metric_rows(spark, sf_dir), path)
    kept = logs.truncate_for_resume(tables.read_table(spark, path), 5000)
    tables.replace_table(kept, path)
    return tables.read_table(spark, path).select("step", "phase", "loss", "accuracy")


POINTS = f"""{sql.METRICS}, points AS (
  SELECT phase || '/loss' AS tag, loss AS value, step FROM metrics UNION ALL
  SELECT phase || '/accuracy', accuracy, step FROM metrics UNION ALL
  SELECT phase || '/learning_rate', learning_rate, step FROM metrics WHERE learning_rate IS NOT NULL)"""


@query(f"WITH {POINTS} SELECT tag, value, step FROM points WHERE step < 5001")
def metrics_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.metrics_long(metric_rows(spark, sf_dir), purge_step=5001)


LINE = """'[PRETRAIN:' || upper(phase) || '] Step ' || step || ' | loss: ' || printf('%.5f', loss)
  || ' | accuracy: ' || printf('%.5f', accuracy)
  || CASE WHEN learning_rate IS NULL THEN '' ELSE ' | learning_rate: ' || printf('%.5f', learning_rate) END"""


@query(f"WITH {sql.METRICS} SELECT step, phase, {LINE} AS line FROM metrics")
def metric_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.metric_lines(metric_rows(spark, sf_dir), "pretrain")


FANNED = f"""WITH {POINTS}
SELECT 'lines' AS sink, step, {LINE} AS line, NULL AS tag, NULL::DOUBLE AS value FROM metrics
UNION ALL SELECT 'points', step, NULL, tag, value FROM points"""


def sink_rows(lines: DataFrame, points: DataFrame) -> DataFrame:
    """What both sinks have written."""
    names = ("sink", "step", "line", "tag", "value")
    lines = lines.withColumns({"sink": F.lit("lines"), "tag": F.lit(None).cast("string"), "value": F.lit(None).cast("double")})
    points = points.withColumns({"sink": F.lit("points"), "line": F.lit(None).cast("string")})
    return lines.select(*names).unionByName(points.select(*names))


@query(FANNED)
def fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same metric rows sent to a line log and a point log."""
    lines, points = new_folder(spark, "lines"), new_folder(spark, "points")
    logs.fan_out(
        metric_rows(spark, sf_dir),
        [
            lambda df: logs.metric_lines(df, "pretrain").write.mode("overwrite").parquet(lines),
            lambda df: logs.metrics_long(df).write.mode("overwrite").parquet(points),
        ],
    )
    return sink_rows(spark.read.parquet(lines), spark.read.parquet(points))


def results(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Evaluation result tables of the stored replies: per prompt and per step."""
    rows = views.generations(spark, sf_dir)
    return generation.evaluation_results(rows, rows, views.dictionary(spark, sf_dir))


@query(
    f"""WITH {SCORED}, upserted AS (
      SELECT step, avg_diversity, avg_lexical_validity, self_bleu FROM summary WHERE step <= 3
      UNION ALL SELECT step, -1.0, -1.0, -1.0 FROM summary WHERE step > 3
      UNION ALL SELECT step + 1000, -1.0, -1.0, -1.0 FROM summary WHERE step > 3)
    SELECT {SUMMARY} FROM upserted"""
)
def upsert_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later steps evaluated again, and as many new steps added."""
    names = ("avg_diversity", "avg_lexical_validity", "self_bleu")
    stored = cut_lineage(results(spark, sf_dir)[1], "results")
    again = stored.where("step > 3").withColumns({c: F.lit(-1.0) for c in names})
    new = again.unionByName(again.withColumn("step", F.col("step") + 1000))
    return rounded(logs.upsert_results(stored, new), *names)


@query(f"WITH {SCORED} SELECT {SUMMARY} FROM summary")
def metric_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = results(spark, sf_dir)[1].withColumn("step", F.col("step").cast("string"))
    return rounded(
        logs.metric_series(keyed), "avg_diversity", "avg_lexical_validity", "self_bleu"
    )


@query(
    f"""WITH {SCORED}, tracked AS (
      SELECT step, output, diversity FROM (
        SELECT *, row_number() OVER (PARTITION BY step ORDER BY prompt_id) AS r
        FROM scored WHERE input = (SELECT min(input) FROM scored)) WHERE r = 1)
    SELECT s.step, t.step IS NOT NULL AS found, output, round(diversity, 6)::DOUBLE AS diversity
    FROM (SELECT DISTINCT step FROM scored) s LEFT JOIN tracked t USING (step)"""
)
def prompt_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first prompt in text order, followed over all steps."""
    prompts, steps = results(spark, sf_dir)
    prompts = cut_lineage(prompts, "results")
    first = prompts.agg(F.min("input")).first()[0]
    return rounded(logs.prompt_history(prompts, steps, first), "diversity")


@query(
    """WITH files AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'pretrain' ELSE 'finetune' END AS task,
        CASE WHEN o_orderkey % 50 = 0 THEN 'x_' ELSE '' END || 'epoch' || (o_custkey % 3)
          || '_step' || o_orderkey || '.pth' AS file FROM orders), parsed AS (
      SELECT task, file, nullif(regexp_extract(file, '^epoch(\\d+)_step(\\d+)\\.pth', 1), '')::BIGINT AS e,
        nullif(regexp_extract(file, '^epoch(\\d+)_step(\\d+)\\.pth', 2), '')::BIGINT AS s FROM files)
    SELECT task, arg_max(file, e * 100000000000 + s) AS file FROM parsed GROUP BY task"""
)
def latest_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.latest_checkpoint(views.checkpoint_files(spark, sf_dir))


FILTERED = f"""{sql.LOGITS}, ranked AS (
  SELECT ctx_id, token_id, x, rank() OVER (PARTITION BY ctx_id ORDER BY x DESC) AS r FROM (
    SELECT ctx_id, (i - 1)::INT AS token_id, logits[i]::DOUBLE / 0.8::DOUBLE AS x
    FROM (SELECT ctx_id, logits, unnest(range(1, len(logits) + 1)) AS i FROM logit_rows))),
weighted AS (SELECT *, exp(x - max(x) OVER (PARTITION BY ctx_id)) AS w FROM ranked WHERE r <= 20),
summed AS (SELECT *, sum(w) OVER (PARTITION BY ctx_id) AS total, coalesce(sum(w) OVER (
    PARTITION BY ctx_id ORDER BY x DESC, token_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    AS before FROM weighted),
probs AS (SELECT ctx_id, token_id, x, w / sum(w) OVER (PARTITION BY ctx_id) AS prob
  FROM summed WHERE before <= 0.9::DOUBLE * total)"""


def filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.logit_rows(spark, sf_dir)
    return generation.filter_logits(rows, temperature=0.8, top_k=20, top_p=0.9)


@query(f"WITH {FILTERED} SELECT ctx_id, token_id, round(prob, 6) AS prob FROM probs")
def filter_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filtered(spark, sf_dir).select("ctx_id", F.inline("probs"))
    return rounded(rows, "prob")


@query(
    f"""WITH {FILTERED}, cumulative AS (
      SELECT *, sum(prob) OVER (PARTITION BY ctx_id ORDER BY x DESC, token_id) AS upto,
        ('0x' || substr(md5('42:' || ctx_id), 1, 8))::BIGINT / 4294967296::DOUBLE AS u FROM probs)
    SELECT ctx_id, coalesce(arg_min(token_id, upto) FILTER (WHERE upto > u),
      arg_max(token_id, upto)) AS token_id FROM cumulative GROUP BY ctx_id"""
)
def draw_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = generation.draw_token(filtered(spark, sf_dir), 42, "ctx_id")
    return drawn.select("ctx_id", "token_id")


MODEL = f"""{VOCAB}, {sql.ended()}, pairs AS (
  SELECT doc_id, unnest(list_slice(ids, 1, len(ids) - 1)) AS prev,
         unnest(list_slice(ids, 2, len(ids))) AS next FROM ended), model AS (
  SELECT prev, next, count(*) AS n FROM pairs GROUP BY prev, next)"""


@query(f"WITH {MODEL} SELECT prev, next, n FROM model")
def train_ngram_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids, _, _ = views.encoded_corpus(spark, sf_dir)
    return generation.train_ngram_model(ids)


@query(
    f"""WITH {VOCAB}, {sql.ended()}, placed AS (
      SELECT doc_id, ids, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS position,
             count(*) OVER () AS n FROM ended), pairs AS (
      SELECT doc_id, position <= floor(n * 0.9::DOUBLE) AS train,
             unnest(list_slice(ids, 1, len(ids) - 1)) AS prev,
             unnest(list_slice(ids, 2, len(ids))) AS next FROM placed), model AS (
      SELECT prev, next, count(*) AS n FROM pairs WHERE train GROUP BY prev, next), before AS (
      SELECT prev, sum(n) AS total, arg_max(next, n * 10000000000 - next) AS best
      FROM model GROUP BY prev), sums AS (
      SELECT doc_id, sum(-ln((coalesce(m.n, 0) + 1)::DOUBLE / (coalesce(b.total, 0) + v + 2))) AS loss_sum,
             count(*) FILTER (WHERE coalesce(best, 0) = p.next) AS correct, count(*) AS total
      FROM pairs p CROSS JOIN size LEFT JOIN model m ON m.prev = p.prev AND m.next = p.next
      LEFT JOIN before b ON b.prev = p.prev WHERE NOT train GROUP BY doc_id)
    SELECT {summary_columns('doc_id')} FROM ({summary('sums')})"""
)
def score_ngram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model of the train split scored on every document of the rest."""
    ids, _, eos = views.encoded_corpus(spark, sf_dir)
    order = views.table(spark, sf_dir, "documents").select("doc_id")
    placed = cut_lineage(assembly.seeded_shuffle(order, "doc_id"), "split")
    split = assembly.train_val_split(placed).select("doc_id", "split")
    marked = cut_lineage(ids.join(split, "doc_id"), "marked")
    model = cut_lineage(
        generation.train_ngram_model(marked.where("split = 'train'")), "model"
    )
    held_out = marked.where("split = 'val'")
    return summary_rows(
        metrics.loss_summary(generation.score_ngram(held_out, model, eos + 2, ["doc_id"]))
    )


def prompt_ids(spark: SparkSession, sf_dir: str, vocab: DataFrame, unknown: int) -> DataFrame:
    rows = views.prompts(spark, sf_dir)
    ids = tokens.encode(rows, vocab, unknown, "prompt_id")
    return cut_lineage(ids.join(rows.select("prompt_id", "input"), "prompt_id"), "prompts")


def completion(seed: int, keep: str, name: str, asked: str = "prompt_ids", most: str = "16") -> str:
    """Recursive CTE: ``name(key, step, last, out)`` over the successors kept by ``keep``."""
    return f"""{name}_succ AS (
  SELECT prev, list(next ORDER BY n DESC, next) AS nexts, list(upto ORDER BY n DESC, next) AS uptos FROM (
    SELECT prev, next, n, sum(n) OVER w / sum(n) OVER (PARTITION BY prev) AS upto
    FROM (SELECT *, row_number() OVER (PARTITION BY prev ORDER BY n DESC, next) AS r FROM model) {keep}
    WINDOW w AS (PARTITION BY prev ORDER BY n DESC, next)) GROUP BY prev), {name} AS (
  SELECT prompt_id AS key, 0 AS step, ids[len(ids)] AS last, []::INT[] AS out FROM {asked}
  UNION ALL
  SELECT key, step + 1, CASE WHEN t <> (SELECT v FROM size) THEN t END, list_append(out, t) FROM (
    SELECT c.key, c.step, c.out, coalesce(
      list_first(list_filter(nexts, lambda x, i: uptos[i] >
        ('0x' || substr(md5('{seed}:' || c.key || ':' || c.step), 1, 8))::BIGINT / 4294967296::DOUBLE)),
      nexts[len(nexts)], (SELECT v FROM size)) AS t
    FROM {name} c LEFT JOIN {name}_succ s ON s.prev = c.last
    WHERE c.last IS NOT NULL AND c.step < {most})), {name}_text AS (
  SELECT key AS prompt_id, coalesce((SELECT string_agg(word, ' ' ORDER BY i) FROM (
      SELECT unnest(out) AS id, generate_subscripts(out, 1) AS i) JOIN vocab USING (id)), '') AS output
  FROM (SELECT key, arg_max(out, step) AS out FROM {name} GROUP BY key))"""


PROMPT_IDS = f"""{MODEL}, prompt_places AS (
  SELECT item_id AS prompt_id, unnest({sql.words('text')}) AS word,
         generate_subscripts({sql.words('text')}, 1) AS pos FROM benchmark), prompt_ids AS (
  SELECT prompt_id, list(coalesce(id, (SELECT v + 1 FROM size)) ORDER BY pos) AS ids
  FROM prompt_places LEFT JOIN vocab USING (word) GROUP BY prompt_id)"""
GREEDY, SAMPLED = "WHERE r = 1", ""


@query(
    f"""WITH RECURSIVE {PROMPT_IDS}, {completion(42, GREEDY, 'done')}
    SELECT prompt_id, output FROM done_text"""
)
def complete_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likeliest continuation of every prompt, sixteen tokens at most."""
    ids, vocab, eos = views.encoded_corpus(spark, sf_dir)
    model = generation.train_ngram_model(ids)
    asked = prompt_ids(spark, sf_dir, vocab, eos + 1)
    # A temperature near zero leaves all probability to the first token.
    out = generation.complete_prompts(asked, model, eos, max_tokens=16, top_p=0.0)
    return tokens.decode(out, vocab, "prompt_id", "output_ids").withColumnRenamed("text", "output")


#: Settings that differ in every request, the same in Spark and in SQL.
REQUEST_SETTINGS = {
    "temperature": "CASE WHEN prompt_id % 7 <> 0 THEN 0.3 + prompt_id * 0.001 END",
    "top_k": "CASE WHEN prompt_id % 3 <> 0 THEN 2 + prompt_id % 40 END",
    "nucleus": "CASE WHEN prompt_id % 4 = 0 THEN 0.0 WHEN prompt_id % 4 = 1 THEN 0.5 + prompt_id % 50 * 0.01 END",
    "most": "3 + prompt_id % 10",
}


@query(
    f"""WITH RECURSIVE {PROMPT_IDS}, requests AS (
      SELECT prompt_id, ids, coalesce({REQUEST_SETTINGS['temperature']}, 1.0)::DOUBLE AS temperature,
        coalesce({REQUEST_SETTINGS['top_k']}, -1) AS top_k, coalesce({REQUEST_SETTINGS['nucleus']}, 1.0)::DOUBLE AS top_p,
        {REQUEST_SETTINGS['most']} AS most FROM prompt_ids),
    following AS (SELECT *, rank() OVER (PARTITION BY prev ORDER BY n DESC) AS place,
      max(n) OVER (PARTITION BY prev) AS top FROM model),
    done AS (
      SELECT prompt_id AS key, 0 AS step, ids[len(ids)] AS last, []::INT[] AS out, temperature, top_k, top_p, most FROM requests
      UNION ALL
      SELECT key, step + 1, CASE WHEN t <> (SELECT v FROM size) THEN t END, list_append(out, t), temperature, top_k, top_p, most
      FROM (
        SELECT key, step, out, temperature, top_k, top_p, most, coalesce(
          arg_min(next, upto) FILTER (WHERE upto > kept * u), arg_max(next, upto), (SELECT v FROM size)) AS t
        FROM (
          SELECT *, sum(w) OVER (PARTITION BY key ORDER BY n DESC, next) AS upto, sum(w) OVER (PARTITION BY key) AS kept,
            ('0x' || substr(md5('42:' || key || ':' || step), 1, 8))::BIGINT / 4294967296::DOUBLE AS u
          FROM (
            SELECT *, sum(w) OVER (PARTITION BY key) AS total, coalesce(sum(w) OVER (PARTITION BY key ORDER BY n DESC, next
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
            FROM (
              SELECT done.*, next, n, pow(n::DOUBLE / top, 1 / temperature) AS w
              FROM done LEFT JOIN following ON prev = last AND (top_k <= 0 OR place <= top_k)
              WHERE last IS NOT NULL AND step < most))
          WHERE n IS NULL OR top_p >= 1 OR before <= top_p * total)
        GROUP BY key, step, out, temperature, top_k, top_p, most)),
    answers AS (SELECT key AS prompt_id, arg_max(out, step) AS out FROM done GROUP BY key)
    SELECT prompt_id, coalesce((SELECT string_agg(word, ' ' ORDER BY i) FROM (
      SELECT unnest(out) AS id, generate_subscripts(out, 1) AS i) JOIN vocab USING (id)), '') AS output FROM answers"""
)
def complete_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that each bring their own temperature, filters and number of tokens."""
    ids, vocab, eos = views.encoded_corpus(spark, sf_dir)
    asked = prompt_ids(spark, sf_dir, vocab, eos + 1)
    asked = asked.withColumns({name: F.expr(value) for name, value in REQUEST_SETTINGS.items()})
    out = generation.complete_prompts(
        asked, generation.train_ngram_model(ids), eos, max_tokens="most",
        temperature="temperature", top_k="top_k", top_p="nucleus",
    )
    return tokens.decode(out, vocab, "prompt_id", "output_ids").withColumnRenamed("text", "output")


SAMPLES = 5


@query(
    f"""WITH RECURSIVE {PROMPT_IDS}, first_prompt AS (
      SELECT range AS prompt_id, (SELECT arg_min(ids, prompt_id) FROM prompt_ids) AS ids FROM range({SAMPLES})),
    {completion(42, SAMPLED, 'done')}, {completion(7, SAMPLED, 'again', 'first_prompt')},
    {sql.DICTIONARY}, validity AS ({validity('done_text', 'prompt_id', 'output')}), scored AS (
      SELECT prompt_id, output, {sql.diversity('output')} AS diversity, lexical_validity
      FROM done_text JOIN validity USING (prompt_id)), sampled AS (SELECT 1 AS step, * FROM again_text),
    {sql.self_bleu('sampled', 'step', 'prompt_id', 'output')}
    SELECT 3000 AS step, prompt_id, output, round(diversity, 6)::DOUBLE AS diversity,
      round(lexical_validity, 6)::DOUBLE AS lexical_validity, NULL::DOUBLE AS self_bleu FROM scored
    UNION ALL
    SELECT 3000, NULL, NULL, round(avg(diversity), 6)::DOUBLE, round(avg(lexical_validity), 6)::DOUBLE,
      round(any_value(self_bleu), 6)::DOUBLE FROM scored, bleu"""
)
def evaluate_prompt_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prompt completed and scored, one prompt sampled for self-BLEU: a row per
    prompt, and one without a prompt for the step."""
    ids, vocab, eos = views.encoded_corpus(spark, sf_dir)
    model = generation.train_ngram_model(ids)
    asked = prompt_ids(spark, sf_dir, vocab, eos + 1)
    one = asked.orderBy("prompt_id").limit(1).select("input_ids")
    samples = one.select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SAMPLES - 1).cast("long"))).alias("prompt_id"),
        "input_ids",
    )
    scored, summary = generation.evaluate_prompt_suite(
        3000, asked, samples, model, vocab, views.dictionary(spark, sf_dir), eos,
        max_tokens=16, sample_seed=7,
    )
    rows = scored.select(
        "step", "prompt_id", "output", "diversity", "lexical_validity",
        F.lit(None).cast("double").alias("self_bleu"),
    )
    steps = summary.select(
        "step", F.lit(None).cast("long").alias("prompt_id"), F.lit(None).cast("string").alias("output"),
        F.col("avg_diversity").alias("diversity"), F.col("avg_lexical_validity").alias("lexical_validity"),
        "self_bleu",
    )
    return rounded(rows.unionByName(steps), "diversity", "lexical_validity", "self_bleu")
