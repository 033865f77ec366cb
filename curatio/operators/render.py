"""Dialogue text renderings.

The rendering of one dialogue is one output string, so its messages are
gathered per dialogue (bounded by that dialogue's length, which is the
size of the answer); no other grouping is done.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .dialogs import positions
from .turns import message_pairs


def _ordered_texts(df: DataFrame, key: str, order: str, value: Column, name: str) -> DataFrame:
    return (df.groupBy(key)
            .agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))).alias("_a"))
            .select(key, F.transform("_a", lambda x: x["v"]).alias(name)))


def answer_only_text(conv: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Responses (odd positions) joined by newline."""
    p = positions(conv, True, conv_col=conv_col).filter(F.col("pos") % 2 == 1)
    t = _ordered_texts(p, conv_col, "pos", F.col("text"), "_t")
    return t.select(conv_col, F.array_join("_t", "\n").alias("answer_text"))


def complete_rounds(conv: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """B8 in long form: (instruction, response) pairs that both exist
    (``zip`` stops at the shorter list)."""
    return message_pairs(conv, conv_col=conv_col).where("has_response").drop("has_response")


def history_text(conv: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """``[HUMAN]: q\\n[AI]: a\\n`` for every complete round, in order."""
    r = complete_rounds(conv, conv_col)
    piece = F.concat(F.lit("[HUMAN]: "), F.col("instruction"), F.lit("\n[AI]: "), F.col("response"), F.lit("\n"))
    t = _ordered_texts(r, conv_col, "pair_idx", piece, "_t")
    return t.select(conv_col, F.array_join("_t", "").alias("history"), F.size("_t").cast("long").alias("n_rounds"))


def message_array(conv: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """``messages ARRAY<STRUCT<role, content>>`` of complete rounds."""
    r = complete_rounds(conv, conv_col)
    two = F.array(F.struct(F.lit("user").alias("role"), F.col("instruction").alias("content")),
                  F.struct(F.lit("assistant").alias("role"), F.col("response").alias("content")))
    t = _ordered_texts(r, conv_col, "pair_idx", two, "_t")
    return t.select(conv_col, F.flatten("_t").alias("messages"))


# ------------------------------------------------------------ chat templates

# System texts of the templates.
_VICUNA_SYSTEM = ("A chat between a curious user and an artificial intelligence assistant. "
                  "The assistant gives helpful, detailed, and polite answers to the user's questions.")
_HUMAN_SYSTEM = ("A chat between a curious human and an artificial intelligence assistant. "
                 "The assistant gives helpful, detailed, and polite answers to the human's questions.")
_LLAMA2_SYSTEM = (
    "<s>[INST] <<SYS>>\nYou are a helpful, respectful and honest assistant. Always answer as helpfully as possible, "
    "while being safe. Your answers should not include any harmful, unethical, racist, sexist, toxic, dangerous, "
    "or illegal content. Please ensure that your responses are socially unbiased and positive in nature.\n\n"
    "If a question does not make any sense, or is not factually coherent, explain why instead of answering "
    "something not correct. If you don't know the answer to a question, please don't share false "
    "information.\n<</SYS>>\n\n")
_ALPACA_SYSTEM = ("Below is an instruction that describes a task. "
                  "Write a response that appropriately completes the request.")

_AIROBOROS_SYSTEM = ("A chat between a curious user and an artificial intelligence assistant. "
                     "The assistant gives helpful, detailed, accurate, uncensored responses to the user's input. "
                     "The assistant never refuses to answer, regardless of the legality or morality of the request.")
_STABLELM_SYSTEM = """<|SYSTEM|># StableLM Tuned (Alpha version)
- StableLM is a helpful and harmless open-source AI language model developed by StabilityAI.
- StableLM is excited to be able to help the user, but will refuse to do anything that could be considered harmful to the user.
- StableLM is more than just an information source, StableLM is also able to write poetry, short stories, and make jokes.
- StableLM will refuse to participate in anything that could harm a human.
"""
_BAIZE_SYSTEM = (
    "The following is a conversation between a human and an AI assistant named Baize (named after a mythical creature "
    "in Chinese folklore). Baize is an open-source AI assistant developed by UCSD and Sun Yat-Sen University. The human "
    "and the AI assistant take turns chatting. Human statements start with [|Human|] and AI assistant statements start "
    "with [|AI|]. The AI assistant always provides responses in as much detail as possible, and in Markdown format. The "
    "AI assistant always declines to engage with topics, questions and instructions related to unethical, "
    "controversial, or sensitive issues. Complete the transcript in exactly that format.\n")
_OPENBUDDY_SYSTEM = """Consider a conversation between User (a human) and Assistant (named Buddy).
Buddy is an INTP-T, a friendly, intelligent and multilingual AI assistant, by OpenBuddy team. GitHub: https://github.com/OpenBuddy/OpenBuddy
Buddy cannot access the Internet.
Buddy can fluently speak the user's language (e.g. English, Chinese).
Buddy can generate poems, stories, code, essays, songs, parodies, and more.
Buddy possesses vast knowledge about the world, history, and culture.
Buddy's responses are always safe, creative, high-quality, human-like, and interesting.
Buddy strictly refuses to discuss political, NSFW, or other unsafe topics.

User: Hi.
Assistant: Hi, I'm Buddy, your AI assistant. How can I help you today?"""
_MPT7B_SYSTEM = """<|im_start|>system
- You are a helpful assistant chatbot trained by MosaicML.
- You answer questions.
- You are excited to be able to help the user, but will refuse to do anything that could be considered harmful to the user.
- You are more than just an information source, you are also able to write poetry, short stories, and make jokes."""
_MPT30B_SYSTEM = """<|im_start|>system
A conversation between a user and an LLM-based AI assistant. The assistant gives helpful and honest answers."""
_SNOOZY_SYSTEM = ("### Instruction:\nThe prompt below is a question to answer, a task to complete, or a conversation to "
                  "respond to; decide which and write an appropriate response.")

# Conversation templates (name, style, system, user role,
# assistant role, sep, sep2).  Few-shot messages of a template are not
# used (the embed and training paths clear them).
TEMPLATES = [
    ("vicuna_v1.1", "ADD_COLON_TWO", _VICUNA_SYSTEM, "USER", "ASSISTANT", " ", "</s>"),
    ("vicuna_simple", "ADD_COLON_TWO", "", "USER", "ASSISTANT", " ", "</s>"),
    ("koala_v1", "ADD_COLON_TWO", "BEGINNING OF CONVERSATION:", "USER", "GPT", " ", "</s>"),
    ("alpaca", "ADD_COLON_TWO", _ALPACA_SYSTEM, "### Instruction", "### Response", "\n\n", "</s>"),
    ("chatglm", "CHATGLM", "", "问", "答", "\n", None),
    ("chatglm2", "CHATGLM", "", "问", "答", "\n\n", None),
    ("dolly_v2", "DOLLY", _ALPACA_SYSTEM + "\n\n", "### Instruction", "### Response", "\n\n", "### End"),
    ("oasst_pythia", "NO_COLON_SINGLE", "", "<|prompter|>", "<|assistant|>", "<|endoftext|>", None),
    ("oasst_llama", "NO_COLON_SINGLE", "", "<|prompter|>", "<|assistant|>", "</s>", None),
    ("tulu", "ADD_NEW_LINE_SINGLE", "", "<|user|>", "<|assistant|>", "\n", None),
    ("rwkv", "RWKV", "", "Bob", "Alice", "", None),
    ("phoenix", "PHOENIX", _HUMAN_SYSTEM + "\n\n", "Human", "Assistant", "</s>", None),
    ("billa", "ADD_COLON_SPACE_SINGLE", "", "Human", "Assistant", "\n", None),
    ("Robin", "ROBIN", _HUMAN_SYSTEM, "###Human", "###Assistant", "\n", None),
    ("internlm-chat", "CHATINTERN",
     "A chat between a curious <|User|> and an <|Bot|>. The <|Bot|> gives helpful, detailed, and polite "
     "answers to the <|User|>'s questions.\n\n", "<|User|>", "<|Bot|>", "<eoh>", "<eoa>"),
    ("starchat", "CHATML", "<system>\n", "<|user|>", "<|assistant|>", "<|end|>", None),
    ("baichuan-chat", "NO_COLON_TWO", "", " <reserved_102> ", " <reserved_103> ", "", "</s>"),
    ("llama-2", "LLAMA2", _LLAMA2_SYSTEM, "[INST]", "[/INST]", " ", " </s><s>"),
    ("one_shot", "ADD_COLON_SINGLE", _HUMAN_SYSTEM, "Human", "Assistant", "\n### ", None),
    ("zero_shot", "ADD_COLON_SINGLE", _HUMAN_SYSTEM, "Human", "Assistant", "\n### ", None),
    ("airoboros_v1", "ADD_COLON_TWO", _AIROBOROS_SYSTEM, "USER", "ASSISTANT", " ", "</s>"),
    ("stablelm", "NO_COLON_SINGLE", _STABLELM_SYSTEM, "<|USER|>", "<|ASSISTANT|>", "", None),
    ("baize", "NO_COLON_SINGLE", _BAIZE_SYSTEM, "[|Human|]", "[|AI|]", "\n", None),
    ("openbuddy", "ADD_COLON_SINGLE", _OPENBUDDY_SYSTEM, "User", "Assistant", "\n", None),
    ("claude", "ADD_COLON_SINGLE", "", "Human", "Assistant", "\n\n", None),
    ("mpt-7b-chat", "CHATML", _MPT7B_SYSTEM, "<|im_start|>user", "<|im_start|>assistant", "<|im_end|>", None),
    ("mpt-30b-chat", "CHATML", _MPT30B_SYSTEM, "<|im_start|>user", "<|im_start|>assistant", "<|im_end|>", None),
    ("mpt-30b-instruct", "ADD_NEW_LINE_SINGLE", _ALPACA_SYSTEM, "### Instruction", "### Response", "\n\n", None),
    ("redpajama-incite", "ADD_COLON_SINGLE", "", "<human>", "<bot>", "\n", None),
    ("h2ogpt", "NO_COLON_SINGLE", "", "<|prompt|>", "<|answer|>", "</s>", None),
    ("snoozy", "ADD_COLON_SINGLE", _SNOOZY_SYSTEM, "### Prompt", "### Response", "\n", None),
    ("manticore", "ADD_COLON_TWO", "", "USER", "ASSISTANT", "\n", "</s>"),
    ("falcon", "RWKV", "", "User", "Assistant", "\n", "<|endoftext|>"),
    ("polyglot_changgpt", "ADD_COLON_SINGLE", "", "B", "A", "\n", None),
    ("tigerbot", "ROBIN", _VICUNA_SYSTEM, "### Instruction", "### Response", "\n\n", None),
    ("xgen", "NO_COLON_SINGLE", _HUMAN_SYSTEM + "\n\n", "### Human: ", "###", "\n", None),
    ("scorer", "SCORER", "", "query", "score", "\n", ""),
]

STYLES = ("ADD_COLON_SINGLE", "ADD_COLON_TWO", "ADD_COLON_SPACE_SINGLE", "ADD_NEW_LINE_SINGLE",
          "NO_COLON_SINGLE", "NO_COLON_TWO", "CHATML", "PHOENIX", "ROBIN", "DOLLY", "SCORER",
          "RWKV", "LLAMA2", "CHATGLM", "CHATINTERN")


def template(name: str):
    for t in TEMPLATES:
        if t[0] == name:
            return dict(zip(("name", "style", "system", "user", "assistant", "sep", "sep2"), t))
    raise KeyError(f"no conversation template {name!r}")


def template_table(spark):
    """The template registry as a DataFrame (broadcast-sized: a fixed list)."""
    return spark.createDataFrame(TEMPLATES, "name string, style string, system string, user_role string, "
                                            "assistant_role string, sep string, sep2 string")


def _piece(t: dict, i, role, msg):
    """Rendering of message ``i`` (0-based) per separator style."""
    style, sep, sep2 = t["style"], t["sep"], t["sep2"]
    s_i = F.when(i % 2 == 0, F.lit(sep)).otherwise(F.lit(sep2 if sep2 is not None else sep))
    empty = msg.isNull() | (msg == "")
    m = F.coalesce(msg, F.lit(""))
    lit = F.lit
    if style == "ADD_COLON_SINGLE":
        return F.when(empty, F.concat(role, lit(":"))).otherwise(F.concat(role, lit(": "), m, lit(sep)))
    if style == "ADD_COLON_TWO":
        return F.when(empty, F.concat(role, lit(":"))).otherwise(F.concat(role, lit(": "), m, s_i))
    if style == "ADD_COLON_SPACE_SINGLE":
        return F.when(empty, F.concat(role, lit(": "))).otherwise(F.concat(role, lit(": "), m, lit(sep)))
    if style == "ADD_NEW_LINE_SINGLE":
        return F.when(empty, F.concat(role, lit("\n"))).otherwise(F.concat(role, lit("\n"), m, lit(sep)))
    if style == "NO_COLON_SINGLE":
        return F.when(empty, role).otherwise(F.concat(role, m, lit(sep)))
    if style == "NO_COLON_TWO":
        return F.when(empty, role).otherwise(F.concat(role, m, s_i))
    if style == "CHATML":
        return F.when(empty, F.concat(role, lit("\n"))).otherwise(F.concat(role, lit("\n"), m, lit(sep), lit("\n")))
    if style == "PHOENIX":
        return F.when(empty, F.concat(role, lit(": <s>"))).otherwise(F.concat(role, lit(": <s>"), m, lit("</s>")))
    if style == "ROBIN":
        return F.when(empty, F.concat(role, lit(":\n"))).otherwise(F.concat(role, lit(":\n"), m, lit(sep)))
    if style == "DOLLY":
        tail = F.when(i % 2 == 1, lit("\n\n")).otherwise(lit(""))
        return F.when(empty, F.concat(role, lit(":\n"))).otherwise(F.concat(role, lit(":\n"), m, s_i, tail))
    if style == "SCORER":
        return m
    if style == "RWKV":
        body = F.replace(F.replace(m, lit("\r\n"), lit("\n")), lit("\n\n"), lit("\n"))
        return F.when(empty, F.concat(role, lit(":"))).otherwise(F.concat(role, lit(": "), body, lit("\n\n")))
    if style == "LLAMA2":
        return (F.when(empty, role).when(i == 0, F.concat(lit(t["system"]), m))
                .otherwise(F.concat(role, lit(" "), m, s_i)))
    if style == "CHATGLM":
        k = (i / 2).cast("int") + lit(1 if t["name"] == "chatglm2" else 0)
        head = F.when(i % 2 == 0, F.concat(lit("[Round "), k.cast("string"), lit("]"), lit(sep))).otherwise(lit(""))
        return F.concat(head, F.when(empty, F.concat(role, lit("："))).otherwise(F.concat(role, lit("："), m, lit(sep))))
    if style == "CHATINTERN":
        head = F.when(i % 2 == 0, lit("<s>")).otherwise(lit(""))
        return F.concat(head, F.when(empty, F.concat(role, lit(":"))).otherwise(F.concat(role, lit(":"), m, s_i, lit("\n"))))
    raise ValueError(f"style {style!r} not supported")


def _start(t: dict) -> str:
    style, system, sep = t["style"], t["system"], t["sep"]
    if style in ("ADD_COLON_SINGLE", "ADD_COLON_TWO", "ADD_COLON_SPACE_SINGLE", "ROBIN"):
        return system + sep
    if style == "ADD_NEW_LINE_SINGLE":
        return "" if system == "" else system + sep
    if style == "CHATML":
        return "" if system == "" else system + sep + "\n"
    if style == "CHATGLM":
        return system + sep if system else ""
    if style in ("SCORER", "LLAMA2"):
        return ""
    return system


def gathered_messages(conv: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """One stored row per dialogue with its messages (leading non-user message dropped), for several renderings."""
    p = positions(conv, True, conv_col=conv_col)
    return stored(p.groupBy(conv_col).agg(F.collect_list(F.struct(F.col("pos").alias("o"), F.col("text").alias("v"))).alias("_m")))


def render(conv: DataFrame, template_name: str, conv_col: str = "conv_id",
           add_generation_prompt: bool = False, gathered: DataFrame | None = None) -> DataFrame:
    """One rendered prompt per dialogue (leading non-user message
    dropped, roles by alternation).  ``add_generation_prompt`` appends the
    empty assistant turn used before generation.  ``gathered``: the
    ``gathered_messages`` of ``conv``, where it is rendered more than once."""
    t = template(template_name)

    def piece(pos, text):
        role = F.when(pos % 2 == 0, F.lit(t["user"])).otherwise(F.lit(t["assistant"]))
        return _piece(t, pos, role, text)

    if gathered is None:
        p = positions(conv, True, conv_col=conv_col)
        per = _ordered_texts(p, conv_col, "pos", piece(F.col("pos"), F.col("text")), "_t")
    else:
        pieces = F.transform("_m", lambda x: F.struct(x["o"].alias("o"), piece(x["o"], x["v"]).alias("v")))
        per = gathered.select(conv_col, F.transform(F.array_sort(pieces), lambda x: x["v"]).alias("_t"))
    body = F.array_join("_t", "")
    if add_generation_prompt:
        # the next (empty) message renders as the role-only piece of its style
        body = F.concat(body, _piece(t, F.size("_t"), F.lit(t["assistant"]), F.lit(None).cast("string")))
    return per.select(conv_col, F.concat(F.lit(_start(t)), body).alias("prompt"))


def role_tagged(conv: DataFrame, conv_col: str = "conv_id", strict: bool = True, eos: str = "</s>") -> DataFrame:
    """``<|system|>\\n..\\n<|user|>\\n..\\n<|assistant|>\\n..<eos>\\n`` with every
    message stripped; an unknown role raises (``strict``) or yields NULL."""
    from ..functions.text import strip
    m = strip(F.col("text"))
    tag = (F.when(F.col("role") == "system", F.concat(F.lit("<|system|>\n"), m, F.lit("\n")))
           .when(F.col("role") == "user", F.concat(F.lit("<|user|>\n"), m, F.lit("\n")))
           .when(F.col("role") == "assistant", F.concat(F.lit("<|assistant|>\n"), m, F.lit(eos + "\n"))))
    if strict:
        tag = tag.otherwise(F.raise_error(F.concat(F.lit("invalid role: "), F.col("role"))))
    per = _ordered_texts(conv, conv_col, "turn", tag, "_t")
    return per.select(conv_col, F.array_join("_t", "").alias("text"))


def instruction_prompt(instruction, inp=None) -> "F.Column":
    """Instruction prompt with an input section only when input is non-empty."""
    head = "Below is an instruction that describes a task"
    if inp is None:
        return F.concat(F.lit(head + ". Write a response that appropriately completes the request.\n\n### Instruction:\n"),
                        instruction, F.lit("\n\n### Response:"))
    return F.when(F.coalesce(inp, F.lit("")) != "", F.concat(
        F.lit(head + ", paired with an input that provides further context. Write a response that appropriately "
              "completes the request.\n\n### Instruction:\n"), instruction, F.lit("\n\n### Input:\n"), inp,
        F.lit("\n\n### Response:"))).otherwise(instruction_prompt(instruction))


def token_mask(conv: DataFrame, max_len: int, conv_col: str = "conv_id") -> DataFrame:
    """Whitespace tokens of a dialogue, each flagged ``is_target`` when it
    comes from an assistant message, cut to ``max_len``."""
    toks = F.transform(F.regexp_extract_all(F.col("text"), F.lit(r"\S+"), 0),
                       lambda w: F.struct(w.alias("token"), (F.col("role") == "assistant").alias("is_target")))
    per = _ordered_texts(conv, conv_col, "turn", toks, "_t")
    return per.select(conv_col, F.slice(F.flatten("_t"), 1, max_len).alias("tokens"))


def inst_format(conv: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """``[INST] user [/INST] answer </s><s>[INST] ...`` (llama-2 chat);
    the leading ``<s>`` is dropped and the text stripped; a system or other
    role raises."""
    from ..functions.text import strip
    piece = (F.when(F.col("role") == "user", F.concat(F.lit("<s>[INST] "), strip(F.col("text")), F.lit(" [/INST]")))
             .when(F.col("role") == "assistant", F.concat(F.lit(" "), F.col("text"), F.lit(" </s>")))
             .otherwise(F.raise_error(F.concat(F.lit("[INST] format does not take role "), F.col("role")))))
    per = _ordered_texts(conv, conv_col, "turn", piece, "_t")
    txt = F.array_join("_t", "")
    return per.select(conv_col, strip(F.when(txt.startswith("<s>"), F.substring(txt, 4, 1 << 30)).otherwise(txt)).alias("text"))


def api_messages(conv: DataFrame, system: str, conv_col: str = "conv_id") -> DataFrame:
    """``[{system}, user, assistant, ...]`` with roles by alternation;
    an empty assistant message is left out."""
    p = positions(conv, True, conv_col=conv_col)
    m = F.struct(F.when(F.col("pos") % 2 == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"),
                 F.col("text").alias("content"))
    keep = p.filter((F.col("pos") % 2 == 0) | (F.coalesce(F.col("text"), F.lit("")) != ""))
    per = _ordered_texts(keep, conv_col, "pos", m, "_t")
    sys_msg = F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")))
    return per.select(conv_col, F.concat(sys_msg, F.col("_t")).alias("messages"))


# Scorer prompt wording.
COMPLEXITY_TEMPLATE = ("You are a helpful assistant. Please identify the complexity score of the following user query. "
                       "\n##Query: {instruction}  \n##Complexity: ")
QUALITY_TEMPLATE = ("You are a helpful assistant. Please identify the quality score of the Response corresponding "
                    "to the Question. \n #Question#:\n{instruction}\n#Response#:\n{output} \n##Quality: ")


def scorer_prompt(kind: str, instruction, output=None):
    """Complexity prompt from the instruction, quality prompt from the
    instruction and the response."""
    tpl = COMPLEXITY_TEMPLATE if kind == "complexity" else QUALITY_TEMPLATE
    out = F.replace(F.lit(tpl), F.lit("{instruction}"), instruction)
    if kind != "complexity":
        out = F.replace(out, F.lit("{output}"), output)
    return out


def preference_strings(df: DataFrame, template_name: str = "vicuna_v1.1") -> DataFrame:
    """(prompt, chosen, rejected) strings from ``prompt, messages,
    chosen[], rejected[]``: the second message of each answer list."""
    t = template(template_name)
    prompt = F.concat(F.lit(t["system"] + t["sep"]), F.col("messages")[0]["role"], F.lit(": "),
                      F.col("prompt"), F.lit(t["sep"]))
    side = lambda c: F.concat(F.get(F.col(c), 1)["role"], F.lit(": "), F.get(F.col(c), 1)["content"],
                              F.lit(t["sep2"] or ""))
    return df.select(prompt.alias("prompt"), side("chosen").alias("chosen"), side("rejected").alias("rejected"))


def prompt_answer_mask(df: DataFrame, source_col: str, target_col: str, max_len: int) -> DataFrame:
    """Source tokens ignored (``is_target`` false), target tokens counted."""
    def toks(c, flag):
        return F.transform(F.regexp_extract_all(F.col(c), F.lit(r"\S+"), 0),
                           lambda w: F.struct(w.alias("token"), F.lit(flag).alias("is_target")))
    return df.withColumn("tokens", F.slice(F.concat(toks(source_col, False), toks(target_col, True)), 1, max_len))


# Label sets of the three rating prompts.
DIFFICULTY_LABELS = ["very easy", "easy", "medium", "hard", "very hard"]
TASK_TAGS = ["Information seeking", "Reasoning", "Planning", "Editing", "Coding & Debugging", "Math",
             "Role playing", "Data analysis", "Creative writing", "Advice seeking", "Brainstorming", "Others"]
INPUT_QUALITY_LABELS = ["very poor", "poor", "average", "good", "excellent"]


def rating_prompt(kind: str, query):
    """Rating prompts (own wording) asking for a JSON label from the
    fixed label sets: ``difficulty``, ``task_tag`` or ``input_quality``."""
    if kind == "difficulty":
        head = ("Identify the intent of the user query below and rate how hard it is as one of: "
                + ", ".join(DIFFICULTY_LABELS) + '. Answer as JSON {"intent": ..., "knowledge": ..., "difficulty": ...}.')
    elif kind == "task_tag":
        head = ("Pick the primary task tag of the user query below from: " + ", ".join(TASK_TAGS)
                + '. Answer as JSON {"primary_tag": ..., "other_tags": [...]}.')
    elif kind == "input_quality":
        head = ("Rate the clarity, specificity and coherence of the user query below as one of: "
                + ", ".join(INPUT_QUALITY_LABELS) + '. Answer as JSON {"explanation": ..., "input_quality": ...}.')
    else:
        raise ValueError("kind must be difficulty, task_tag or input_quality")
    return F.concat(F.lit(head + "\n## User Query\n"), query)


def label_counts(judged: DataFrame, json_col: str, key: str) -> DataFrame:
    """Counts per label parsed from rating outputs (``key`` of the JSON)."""
    lab = F.get_json_object(F.col(json_col), f"$.{key}")
    return judged.groupBy(lab.alias(key)).agg(F.count(F.lit(1)).alias("n"))


def append_message(messages, role: str, content) -> "F.Column":
    """A new message at the end of a dialogue."""
    return F.concat(messages, F.array(F.struct(F.lit(role).alias("role"), content.alias("content"))))


def replace_last_message(messages, content) -> "F.Column":
    """The content of the last message replaced (empty stays empty)."""
    n = F.size(messages)
    last = F.struct(F.element_at(messages, -1)["role"].alias("role"), content.alias("content"))
    return F.when(n > 0, F.concat(F.slice(messages, 1, n - 1), F.array(last))).otherwise(messages)
