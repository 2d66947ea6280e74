"""Projections, predicates and cascades of skip reasons."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.functions.text import capitalised, strip, word_count

Normaliser = Callable[[DataFrame], DataFrame]

# The answers of a logic verdict.
LOGIC_ANSWERS = {"follows": "The case follows.", "does not follow": "The case does not follow."}

# The template of each type of test item; any other type takes the default.
DEFAULT_TEMPLATE = "argument_analysis"
TEMPLATE_OF_TYPE = {
    "statement_vs_nonstatement": "concept_explanation", "identify_argument": "argument_analysis", "argument_vs_explanation": "argument_analysis",
    "validity_judgment": "argument_analysis", "missing_premise": "argument_analysis", "rhetorical_technique": "argument_analysis",
    "statistical_fallacy": "argument_analysis", "analogical_argument_strength": "argument_analysis", "correlation_causation": "argument_analysis",
    "concept_explanation": "concept_explanation", "chain_of_thought": "chain_of_thought", "socratic_dialogue": "socratic_dialogue",
    "argument_analysis": "argument_analysis", "thought_experiment": "thought_experiment", "counterexample_analysis": "argument_analysis",
    "analogical_analysis": "argument_analysis", "conditional_analysis": "argument_analysis", "stress_modal": "concept_explanation",
    "stress_deontic": "concept_explanation", "stress_supervenience": "concept_explanation", "stress_use_mention": "concept_explanation",
    "stress_intensional": "concept_explanation", "stress_self_reference": "concept_explanation", "stress_vagueness": "concept_explanation",
    "stress_counterfactual": "concept_explanation", "stress_abstract": "concept_explanation", "stress_phenomenal": "concept_explanation",
}


def compliant(missing: bool, column: str = "compliant") -> Column:
    """The flag, a missing one counting as `missing`: operators differ in this."""
    return F.coalesce(F.col(column), F.lit(missing))


def filled(column: str) -> Column:
    return strip(F.coalesce(F.col(column), F.lit(""))) != ""


def not_value(column: str, value: str) -> Column:
    """Everything but a value; nulls stay."""
    return ~F.col(column).eqNullSafe(F.lit(value))


def length_within(text: str, low: int, high: int) -> Column:
    return F.char_length(text).between(low, high)


def with_skip_reason(df: DataFrame, reasons: Sequence[tuple[str, Column]], kept: str = "kept") -> DataFrame:
    """The first reason whose condition holds, in the order given; a null condition doesn't hold."""
    chain = reduce(lambda acc, x: acc.when(F.coalesce(x[1], F.lit(False)), x[0]), reasons[1:], F.when(F.coalesce(reasons[0][1], F.lit(False)), reasons[0][0]))
    return df.withColumn("skip_reason", chain.otherwise(kept))


def tiers(score: Column, high: int = 14, mid: tuple[int, int] = (8, 12), low: int = 6) -> Column:
    """high, mid or low; null between the bands."""
    return F.when(score >= high, "high").when(score.between(*mid), "mid").when(score <= low, "low")


def audit_reasoning(df: DataFrame) -> DataFrame:
    """Reasoning records in the common form of an audit."""
    return df.where(compliant(False) & (F.col("ugf_text") != "") & (F.col("topic") != "")).select("id", F.col("topic").alias("query"), F.col("ugf_text").alias("response"), F.coalesce("content_type", F.lit("unknown")).alias("stratum"), F.col("source_model").alias("producer"))


def audit_forms(df: DataFrame) -> DataFrame:
    return df.where(compliant(False) & (F.col("prompt") != "") & (F.col("response") != "")).select("id", F.col("prompt").alias("query"), "response", F.coalesce("form", F.lit("unknown")).alias("stratum"), F.col("teacher").alias("producer"))


def audit_cot(df: DataFrame) -> DataFrame:
    tail = F.coalesce(F.nullif(F.col("conclusion"), F.lit("")), F.nullif(F.col("verdict"), F.lit("")), F.lit(""))
    response = F.when(tail != "", strip(F.concat(F.col("reasoning"), F.lit(" "), tail))).otherwise(F.col("reasoning"))
    stratum = F.concat_ws("_", F.coalesce("track", F.lit("unknown")), F.coalesce("depth", F.lit("unknown")))
    return df.where(compliant(False) & (F.col("reasoning") != "")).select("id", F.coalesce("prompt_text", F.lit("")).alias("query"), response.alias("response"), stratum.alias("stratum"), F.col("source_model").alias("producer"))


#: The handlers of each corpus; callers may add their own.
HANDLERS: dict[str, Normaliser] = {"reasoning": audit_reasoning, "forms": audit_forms, "cot": audit_cot}


def audited(tables: Mapping[str, DataFrame]) -> DataFrame:
    """All corpora in the common form."""
    return reduce(DataFrame.unionByName, [HANDLERS[k](df).withColumn("corpus", F.lit(k)) for k, df in tables.items()])


def unpivoted(df: DataFrame, id_col: str, fields: Sequence[str], least: int = 20) -> DataFrame:
    """One row for each nested text field that holds at least `least` characters."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), strip(F.col(f)).alias("text")) for f in fields]))
    return df.select(id_col, each.alias("x")).select(id_col, "x.field", "x.text").where(F.char_length("text") >= least)


def rendered(df: DataFrame, templates: DataFrame, type_col: str, topic_col: str, default: str | None = None) -> DataFrame:
    """The template of each row's type with {topic} filled in. templates: content_type, template; a small
    dimension. Rows without a template get the default's, or none."""
    t = templates.select(F.col("content_type").alias("_type"), "template")
    out = df.join(t, F.col(type_col) == F.col("_type"), "left").drop("_type")
    if default is not None:
        fallback = templates.where(F.col("content_type") == default).select("template").first()
        out = out.withColumn("template", F.coalesce("template", F.lit(fallback[0] if fallback else None)))
    return out.withColumn("rendered", F.replace(F.col("template"), F.lit("{topic}"), F.col(topic_col))).drop("template")


def template_name(type_col: str) -> Column:
    pairs = [F.lit(x) for kv in TEMPLATE_OF_TYPE.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[F.col(type_col)], F.lit(DEFAULT_TEMPLATE))


def filled_template(template: str, keys: Sequence[str]) -> Column:
    """A message template whose {key} places take the columns of that name, empty where null."""
    out = F.lit(template)
    for k in keys:
        out = F.replace(out, F.lit("{" + k + "}"), F.coalesce(F.col(k).cast("string"), F.lit("")))
    return out


def messages(system: str, shots: Sequence[tuple[str, str]], user: Column) -> Column:
    """A chat: the system's text, worked examples, and the user's message."""
    say = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    parts = [say("system", F.lit(system))]
    for q, a in shots:
        parts += [say("user", F.lit(q)), say("assistant", F.lit(a))]
    return F.array(*parts, say("user", user))


def think_answer(df: DataFrame, marker: str = "So my answer is:", least: int = 10) -> DataFrame:
    """Prompt, reasoning and answer of the usable chain-of-thought records: compliant, with enough
    reasoning, the answer of their track, and the marker in neither."""
    prompt, reasoning, conclusion = (strip(F.coalesce(F.col(c), F.lit(""))) for c in ("prompt_text", "reasoning", "conclusion"))
    unmarked = lambda c: F.instr(F.lower(c), marker.lower()) == 0
    logic = F.create_map(*[F.lit(x) for kv in LOGIC_ANSWERS.items() for x in kv])[F.col("verdict")]
    answer = F.when(F.col("track") == "logic", logic).when((F.col("track") == "philosophy") & (conclusion != "") & unmarked(conclusion), conclusion)
    keep = compliant(False) & (prompt != "") & (reasoning != "") & (word_count(reasoning) >= least) & unmarked(reasoning)
    return df.where(keep).withColumns({"prompt": prompt, "thought": reasoning, "answer": answer}).where("answer is not null")


def both_directions(df: DataFrame, a: str, b: str) -> DataFrame:
    """Every pair as two directed examples."""
    ways = F.array(F.struct(F.lit(f"{a}->{b}").alias("direction"), F.col(a).alias("source_text"), F.col(b).alias("target_text")), F.struct(F.lit(f"{b}->{a}").alias("direction"), F.col(b).alias("source_text"), F.col(a).alias("target_text")))
    return df.select("*", F.explode(ways).alias("_w")).select(*df.columns, "_w.*")


def without(df: DataFrame, *keys: str) -> Column:
    """All columns but the keys, as one struct."""
    return F.struct(*[c for c in df.columns if c not in keys])


def known_entries(bag: str) -> Column:
    """A map without its null entries."""
    return F.map_filter(F.col(bag), lambda k, v: v.isNotNull())


# The inference patterns. Each has the scheme of its premises and conclusion over the parts of a
# scenario (p, q and their negations), and whether it is valid.
RULES = {
    "modus_ponens": ("conditional", "if p then q", "p", "q", True),
    "modus_tollens": ("conditional", "if p then q", "not_q", "not_p", True),
    "denying_antecedent": ("conditional", "if p then q", "not_p", "not_q", False),
    "affirming_consequent": ("conditional", "if p then q", "q", "p", False),
    "disjunctive_syllogism": ("disjunction", "either p or q", "not_p", "q", True),
    "affirming_disjunct": ("disjunction", "either p or q", "p", "not_q", False),
}


def puzzles(df: DataFrame, rule: Column) -> DataFrame:
    """Puzzles from rows with the parts p, q, not_p, not_q of a scenario and the name of a rule:
    premise_1, premise_2, conclusion, is_valid and the question put to a reader. hypothetical_syllogism
    also takes r, the consequence of q."""
    sentence = lambda c: F.concat(capitalised(c), F.lit("."))
    out = df.withColumn("rule", rule)
    first = F.when(F.col("rule").isin([k for k, v in RULES.items() if v[0] == "disjunction"]), F.concat_ws(" ", F.lit("Either"), "p", F.lit("or"), F.concat("q", F.lit(".")))).otherwise(F.concat(F.lit("If "), F.col("p"), F.lit(", then "), F.col("q"), F.lit(".")))
    chain = F.col("rule") == "hypothetical_syllogism"
    second = F.when(chain, F.concat(F.lit("If "), F.col("q"), F.lit(", then "), F.col("r"), F.lit("."))) if "r" in df.columns else F.when(F.lit(False), F.lit(""))
    last = F.when(chain, F.concat(F.lit("If "), F.col("p"), F.lit(", then "), F.col("r"), F.lit("."))) if "r" in df.columns else F.when(F.lit(False), F.lit(""))
    valid = F.when(chain, True)
    for name, (_, _, premise, conclusion, ok) in RULES.items():
        hit = F.col("rule") == name
        second, last, valid = second.when(hit, sentence(F.col(premise))), last.when(hit, sentence(F.col(conclusion))), valid.when(hit, ok)
    out = out.withColumns({"premise_1": first, "premise_2": second, "conclusion": last, "is_valid": valid})
    asked = F.concat(F.concat_ws(" ", "premise_1", "premise_2"), F.lit(" Therefore, "), F.rtrim(F.lower("conclusion"), F.lit(".")), F.lit(". Is this argument valid or invalid? Explain your reasoning."))
    return out.withColumn("question_text", asked)


def structural_gate(vocab_ok: Column, parse_ok: Column, loop: Column, answer_words: Column, scored: Column, least: int = 3) -> Column:
    """The first gate a rollout fails, or ok."""
    return F.when(~vocab_ok, "vocab_fail").when(~parse_ok, "parse_fail").when(loop, "doom_loop").when(answer_words < least, "answer_too_short").when(~scored, "judge_pending").otherwise("ok")


def weighted_reward(substance: Column, engagement: Column, coherence: Column, adequacy: Column) -> Column:
    """The judges' means on 0 to 4, weighted to 0 to 1."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return F.round((0.6 * zero(substance) + 0.2 * zero(engagement) + 0.1 * zero(coherence) + 0.1 * zero(adequacy)) / 4.0, 4)
