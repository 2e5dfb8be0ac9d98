"""Record formats: which prompt, parser, normalisation and scorer a dataset uses, and rows of results built with them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.functions import text

UNAVAILABLE = "ServerUnavailable"


def col(name: str) -> Column:
    return F.col(name)


def mcq_score(predicted: Column) -> Column:
    """(score, correct, gt_answer): the letter against the record's own."""
    gt = text.gt_letter(col("answer"))
    ok = F.coalesce(predicted == gt, F.lit(False))
    return F.struct(ok.cast("double").alias("score"), ok.alias("correct"), gt.alias("gt_answer"))


def soft_matches(predicted: Column, answers: Column) -> Column:
    """How many answers are the prediction, both normalised; the prediction is normalised once, outside the loop over the answers."""
    normal = F.transform(answers, text.normalize_answer)
    return F.get(F.transform(F.array(text.normalize_answer(predicted)), lambda p: F.size(F.filter(normal, lambda a: a == p))), F.lit(0))


def vqa_score(predicted: Column) -> Column:
    """(score, null, null): the leave-one-out score against exactly ten answers; any other number of them raises."""
    n = F.coalesce(F.size("answers"), F.lit(0))
    wrong = F.raise_error(F.concat(F.lit("scoring needs exactly 10 answers, got "), n.cast("string"))).cast("double")
    score = F.when(n == 10, text.soft_score(soft_matches(predicted, col("answers")))).otherwise(wrong)
    return F.struct(score.alias("score"), F.lit(None).cast("boolean").alias("correct"), F.lit(None).cast("string").alias("gt_answer"))


@dataclass(frozen=True)
class Format:
    """Functions of the record's columns (question, choices, context, answers) that make the prompt, read a reply, and score."""

    prompts: dict[str, Callable[[], Column]]
    parsers: dict[str, Callable[[Column], Column]]
    scorer: Callable[[Column], Column] | None
    scorer_id: str
    metric: str
    required: tuple[str, ...]
    normalize: Callable[[Column], Column] = field(default=lambda x: x)


def n_choices() -> Column:
    return F.coalesce(F.size("choices"), F.lit(0))


FORMATS = {
    "mcq": Format(
        {"legacy": lambda: text.mcq_prompt(col("question"), col("choices")), "context": lambda: text.mcq_prompt(col("question"), col("choices"), col("context"))},
        {"v1": text.parse_letter_v1, "v2": lambda reply: text.parse_letter_v2(reply, n_choices())},
        mcq_score, "mcq_exact_v1", "accuracy", ("question", "choices", "answer"),
    ),
    "open_vqa": Format({"short": lambda: text.short_prompt(col("question"))}, {"short": text.parse_short}, vqa_score, "textvqa_mmf_v1", "TextVQA accuracy", ("question", "answers"), text.normalize_answer),
    "raw_only": Format({"plain": lambda: text.plain_prompt(col("question"))}, {"raw": text.parse_raw}, None, "none", "unscored", ("question",)),
}


@dataclass(frozen=True)
class Spec:
    format: str
    prompt: str
    parser: str
    max_tokens: int
    strict: bool = False


#: The datasets and how they are asked and read.
DATASETS = {
    "blink_depth": Spec("mcq", "legacy", "v1", 16),
    "blink_spatial": Spec("mcq", "legacy", "v1", 16),
    "cv_bench": Spec("mcq", "legacy", "v1", 16),
    "scienceqa": Spec("mcq", "context", "v2", 16, True),
    "textvqa": Spec("open_vqa", "short", "short", 32, True),
    "textvqa_1500": Spec("open_vqa", "short", "short", 32, True),
}


def check_registry(specs: dict[str, Spec] | None = None, formats: dict[str, Format] | None = None) -> None:
    """A format, prompt or parser that isn't there raises; nothing falls back."""
    formats = FORMATS if formats is None else formats
    for name, spec in (DATASETS if specs is None else specs).items():
        if spec.format not in formats:
            raise ValueError(f"{name}: no format {spec.format!r}, there are {sorted(formats)}")
        for kind, wanted, there in (("prompt", spec.prompt, formats[spec.format].prompts), ("parser", spec.parser, formats[spec.format].parsers)):
            if wanted not in there:
                raise ValueError(f"{name}: no {kind} {wanted!r} in format {spec.format}")
        if type(spec.max_tokens) is not int or spec.max_tokens < 1:
            raise ValueError(f"{name}: max_tokens is a positive whole number")


def dataset_names(listed: str, specs: dict[str, Spec] | None = None) -> list[str]:
    """The names in a comma-separated list; an unknown one or one given twice raises."""
    names = [x for x in map(str.strip, listed.split(",")) if x]
    if odd := [x for x in names if x not in (DATASETS if specs is None else specs)]:
        raise ValueError(f"unknown datasets: {odd}")
    if len(set(names)) < len(names):
        raise ValueError(f"datasets given twice: {listed}")
    return names


def record_problem(df: DataFrame, spec: Spec) -> Column:
    """The first thing that is wrong with a record of df, or null. A column that is not there is a missing field."""
    rules = []
    for name in ("idx", "image_paths", *FORMATS[spec.format].required):
        rules.append((col(name).isNull() if name in df.columns else F.lit(True), F.lit(f"missing field '{name}'")))
    here = lambda name: col(name) if name in df.columns else F.lit(None)
    if "image_paths" in df.columns:
        rules.append((F.size("image_paths") == 0, F.lit("empty image_paths")))
    if spec.format == "mcq" and "choices" in df.columns:
        rules.append((F.size("choices") == 0, F.lit("empty choices")))
    if spec.format == "open_vqa" and "answers" in df.columns:
        rules.append(((F.size("answers") != 10) | F.exists("answers", F.isnull), F.lit("answers must be a list of exactly 10 strings")))
    rules.append((here("format").isNotNull() & (here("format") != spec.format), F.concat(F.lit("record format "), here("format"), F.lit(f" is not {spec.format}"))))
    if spec.strict and spec.format == "mcq" and {"answer", "choices"} <= set(df.columns):
        rules.append((~text.gt_in_range(col("answer"), col("choices")), F.concat(F.lit("ground truth "), col("answer"), F.lit(" is outside the "), F.size("choices").cast("string"), F.lit(" choices"))))
    return F.coalesce(*[F.when(bad, message) for bad, message in rules])


def record_score(idx: Column | None = None) -> Column:
    """A row's score, else its `correct` as 0 or 1; a row with neither raises."""
    lost = F.raise_error(F.concat(F.lit("neither score nor correct in record "), F.coalesce((col("idx") if idx is None else idx).cast("string"), F.lit("?")))).cast("double")
    return F.coalesce(col("score").cast("double"), col("correct").cast("double"), lost)


def record_key() -> Column:
    """What must be equal for one idx in all runs: the question, and the ground truth or the answers."""
    return F.struct(col("question"), F.coalesce(col("gt_answer"), F.to_json("answers")).alias("truth"))


def shown(predicted: str = "predicted", normalized: str = "prediction_normalized") -> Column:
    """A row's normalised prediction, else its prediction, without blanks around it, in lower case."""
    return F.lower(text.ws_trim(F.coalesce(F.nullif(col(normalized), F.lit("")), col(predicted), F.lit(""))))


def answered() -> Column:
    return (F.coalesce("error", F.lit("")) == "") & col("predicted").isNotNull()


def built_lines(df: DataFrame, name: str, config: str, specs: dict[str, Spec] | None = None, version: str = "2") -> DataFrame:
    """Result rows from records beside their responses. df has the record's columns and response (JSON), error, error_type,
    retried, mem_avail_mb, rec_no. A failed request has empty predictions and null scores; its ground truth stays."""
    spec = (DATASETS if specs is None else specs)[name]
    fmt = FORMATS[spec.format]
    df = df.withColumn("_failed", F.coalesce("error", F.lit("")) != "")
    ok = lambda x, default=None: F.when(~col("_failed"), x).otherwise(F.lit(default))
    got = lambda path, default: F.coalesce(F.get_json_object("response", path), F.lit(default))
    df = df.withColumn("prediction_raw", ok(got("$.choices[0].message.content", ""), ""))
    df = df.withColumn("predicted", ok(fmt.parsers[spec.parser](col("prediction_raw")), ""))
    out = {
        "dataset": F.lit(name), "config": F.lit(config), "format": F.lit(spec.format), "parser": F.lit(spec.parser), "protocol_version": F.lit(version),
        "prediction_normalized": ok(fmt.normalize(col("predicted")), ""), "tok_s": F.coalesce(ok(F.get_json_object("response", "$.timings.predicted_per_second").cast("double")), F.lit(0.0)),
        "finish_reason": ok(F.get_json_object("response", "$.choices[0].finish_reason")), "error": F.when(col("_failed"), col("error")), "error_type": F.when(col("_failed"), col("error_type")),
    }
    scored = fmt.scorer(col("predicted")) if fmt.scorer else F.lit(None).cast("struct<score: double, correct: boolean, gt_answer: string>")
    df = df.withColumns(out | {"_scored": F.when(~col("_failed"), scored)})
    truth = text.gt_letter(col("answer")) if spec.format == "mcq" else F.lit(None).cast("string")
    df = df.withColumns({"score": col("_scored.score"), "correct": col("_scored.correct"), "gt_answer": truth})
    if spec.format == "mcq":
        df = df.withColumns({"pred_parser_v1": ok(text.parse_letter_v1(col("prediction_raw")), ""), "pred_parser_v2": ok(text.parse_letter_v2(col("prediction_raw"), n_choices()), "")})
    return df.drop("_failed", "_scored", "response", "answer")


def swapped(df: DataFrame) -> DataFrame:
    """Records of two choices in the other order; any other record raises."""
    letter = F.regexp_extract(text.ws_trim(col("answer")), r"^\(([AB])\)$", 1)
    odd = F.raise_error(F.concat(F.lit("can't swap record "), col("idx").cast("string"))).cast("string")
    answer = F.when((F.size("choices") == 2) & (letter != ""), F.concat(F.lit("("), text.flip_letter(letter), F.lit(")"))).otherwise(odd)
    return df.withColumns({"answer": answer, "choices": F.reverse("choices"), "swapped": F.lit(True)})


def run_settings(config: dict, dataset: str, spec: Spec, data_sha256: str, manifest_sha256: str | None, hashes: dict[str, str | None], limits: dict[str, object]) -> dict[str, object]:
    """The settings that a run's rows depend on, all eighteen. config: num, short, mmproj, model; hashes: of mmproj and model, by these names; limits:
    protocol_version, temperature, ctx_size, n_gpu_layers."""
    return {
        "protocol_version": limits["protocol_version"], "config_num": config["num"], "config_short": config["short"], "mmproj": config["mmproj"], "model": config["model"],
        "mmproj_sha256": hashes.get(config["mmproj"]), "model_sha256": hashes.get(config["model"]), "dataset": dataset, "format": spec.format, "prompt": spec.prompt, "parser": spec.parser,
        "scorer": FORMATS[spec.format].scorer_id, "max_tokens": spec.max_tokens, "temperature": limits["temperature"], "ctx_size": limits["ctx_size"], "n_gpu_layers": limits["n_gpu_layers"],
        "data_sha256": data_sha256, "manifest_sha256": manifest_sha256,
    }


def fingerprint(settings: dict[str, object]) -> Column:
    """Settings as a map of strings, null where a setting has no value."""
    return F.create_map(*[F.lit(x) if i % 2 == 0 or x is not None else F.lit(None).cast("string") for pair in sorted(settings.items()) for i, x in enumerate((pair[0], None if pair[1] is None else str(pair[1])))])


def fingerprint_diff(old: Column, new: Column) -> Column:
    """`key: old -> new` for each key, in order, whose values differ; a key that one side lacks is null there."""
    keys = F.array_sort(F.array_union(F.map_keys(old), F.map_keys(new)))
    value = lambda m, k: F.try_element_at(m, k)
    shown_ = lambda m, k: F.coalesce(value(m, k), F.lit("null"))
    return F.transform(F.filter(keys, lambda k: ~value(old, k).eqNullSafe(value(new, k))), lambda k: F.concat(k, F.lit(": "), shown_(old, k), F.lit(" -> "), shown_(new, k)))
