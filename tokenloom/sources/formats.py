"""Importers of vocabulary formats.  They run once, on the driver, and end in a Definition."""

from __future__ import annotations

import base64
import json
import re
import struct
from collections import deque
from dataclasses import replace
from typing import Any

from ..definition import Definition, DefinitionError, Special, Step, step
from ..functions.normalize import ALL
from ..functions.patterns import literal

#: Pre-token patterns of public byte-level vocabularies.
P50K = r"'(?:[sdmt]|ll|ve|re)|\s?\p{L}+|\s?\p{N}+|\s?[^\s\p{L}\p{N}]+"
CL100K = r"'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]++[\r\n]*|\s*[\r\n]|\s+(?!\S)"
O200K = (
    r"[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]*[\p{Ll}\p{Lm}\p{Lo}\p{M}]+(?i:'s|'t|'re|'ve|'m|'ll|'d)?|"
    r"[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]+[\p{Ll}\p{Lm}\p{Lo}\p{M}]*(?i:'s|'t|'re|'ve|'m|'ll|'d)?|"
    r"\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n/]*|\s*[\r\n]+|\s+(?!\S)"
)
KIMI = (
    r"[\p{Han}]+|"
    r"[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}&&[^\p{Han}]]*[\p{Ll}\p{Lm}\p{Lo}\p{M}&&[^\p{Han}]]+(?i:'s|'t|'re|'ve|'m|'ll|'d)?|"
    r"[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}&&[^\p{Han}]]+[\p{Ll}\p{Lm}\p{Lo}\p{M}&&[^\p{Han}]]*(?i:'s|'t|'re|'ve|'m|'ll|'d)?|"
    r"\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)"
)
#: Special tokens of these vocabularies and their ids.
CL100K_SPECIALS = {"<|endoftext|>": 100257, "<|fim_prefix|>": 100258, "<|fim_middle|>": 100259, "<|fim_suffix|>": 100260, "<|endofprompt|>": 100276, "<|im_start|>": 100264, "<|im_end|>": 100265}
O200K_SPECIALS = {"<|endoftext|>": 199999, "<|endofprompt|>": 200018}
P50K_SPECIALS = {"<|endoftext|>": 50256, "<|fim_prefix|>": 50281, "<|fim_middle|>": 50282, "<|fim_suffix|>": 50283}
#: Special tokens whose ids follow the vocabulary; a pair stands for numbered reserved names, (prefix, range of numbers).
KIMI_SPECIALS = ["<|im_end|>", "<|im_user|>", "<|im_assistant|>", "<|start_header_id|>", "<|end_header_id|>", "[EOT]", "<|im_system|>", "<|im_middle|>"]
LLAMA4_SPECIALS = [
    "<|begin_of_text|>", "<|end_of_text|>", "<|fim_prefix|>", "<|fim_middle|>", "<|fim_suffix|>", "<|header_start|>", "<|header_end|>", "<|eom|>", "<|eot|>", "<|step|>",
    ("text_post_train_", range(0, 6)),
    "<|python_start|>", "<|python_end|>", "<|finetune_right_pad|>",
    ("text_post_train_", range(8, 69)),
    "<|image_start|>", "<|image_end|>", "<|vision_reserved_special_token_0|>", "<|vision_reserved_special_token_1|>", "<|tile_x_separator|>", "<|tile_y_separator|>",
    "<|vision_reserved_special_token_2|>", "<|vision_reserved_special_token_3|>", "<|vision_reserved_special_token_4|>", "<|vision_reserved_special_token_5|>",
    "<|image|>", "<|vision_reserved_special_token_6|>", "<|patch|>",
    ("vision_", range(7, 1048)),
    ("reasoning_", range(0, 7)),
    "<|reasoning_thinking_start|>", "<|reasoning_thinking_end|>",
]
#: What special tokens are for.
TIKTOKEN_IDENTS = {"<|begin_of_text|>": "bos", "<|end_of_text|>": "eos", "<|endoftext|>": "eos", "<|eot|>": "eot", "<|eom|>": "eom", "<|finetune_right_pad|>": "pad"}
#: The first special tokens of tekken files, and those that have a purpose and aren't cut out before normalization.
TEKKEN_SPECIALS = ("<unk>", "<s>", "</s>", "[INST]", "[/INST]", "[AVAILABLE_TOOLS]", "[/AVAILABLE_TOOLS]", "[TOOL_RESULTS]", "[/TOOL_RESULTS]", "[TOOL_CALLS]", "<pad>", "[PREFIX]", "[MIDDLE]", "[SUFFIX]")
TEKKEN_IDENTS = {"<unk>": "unk", "<s>": "bos", "</s>": "eos", "<pad>": "pad"}
#: Fixed value: spaces before these are taken away when word pieces are joined.
CLEANUP = r"[ ](\.|\?|\!|\,|n't|'m|'s|'ve|'re)"


def regex(pattern: str, behaviour: str) -> Step:
    return step("split", kind="regex", pattern=pattern, behaviour=behaviour)


def numbered(names: list, first: int) -> dict[str, int]:
    flat = [x for n in names for x in ([n] if isinstance(n, str) else [f"<|{n[0]}reserved_special_token_{i}|>" for i in n[1]])]
    return {name: first + i for i, name in enumerate(flat)}


def tiktoken_kind(n: int) -> tuple[str, dict[str, int], tuple]:
    """Pattern, special tokens and templates by the vocabulary's size; files say nothing of them."""
    if n == 200_000:
        return O200K, numbered(LLAMA4_SPECIALS, n), (("<|begin_of_text|>", "sequence_start"), ("<|end_of_text|>", "sequence_end"))
    if n == 163_584:
        return KIMI, numbered(KIMI_SPECIALS, n), ()
    if n >= 199_990:
        return O200K, O200K_SPECIALS, ()
    return (CL100K, CL100K_SPECIALS, ()) if n >= 100_000 else (P50K, P50K_SPECIALS, ())


def from_tiktoken(data: bytes) -> Definition:
    """Lines of base64 and id; the line order is the rank."""
    vocab = []
    for line in data.split(b"\n"):
        if line.strip(b"\r"):
            token, _, number = line.strip(b"\r").partition(b" ")
            vocab.append((int(number), base64.b64decode(token, validate=True)))
    if not vocab:
        raise DefinitionError("no tokens")
    pattern, specials, templates = tiktoken_kind(len(vocab))
    marks = tuple(Special(i, t.encode(), "control", float(k), True, TIKTOKEN_IDENTS.get(t)) for k, (t, i) in enumerate(specials.items()))
    return Definition("bytepair", tuple(vocab), chars=False, specials=marks, split=(regex(pattern, "isolate"),), source="tiktoken", templates=templates).validated()


def from_tekken(data: bytes) -> Definition:
    """JSON with base64 tokens; ids follow the special tokens, and the vocabulary is cut to the default size, in the file's order."""
    body = json.loads(data)
    config = body["config"]
    wanted = config.get("default_num_special_tokens")
    n = len(TEKKEN_SPECIALS) if wanted is None else int(wanted)
    size = config.get("default_vocab_size")
    size = len(body["vocab"]) if size is None else int(size)
    names = [*TEKKEN_SPECIALS, *(f"<SPECIAL_{i}>" for i in range(len(TEKKEN_SPECIALS), n))]
    if size > len(body["vocab"]) + n:
        raise DefinitionError(f"{size} tokens are wanted, {len(body['vocab']) + n} are there")
    if size < len(names):
        raise DefinitionError(f"{size} tokens leave no room for {len(names)} special tokens")
    vocab = sorted((int(x["rank"]) + len(names), base64.b64decode(x["token_bytes"])) for x in body["vocab"][: size - len(names)])
    marks = tuple(Special(i, t.encode(), "unknown" if t == "<unk>" else "control", float(i), t not in TEKKEN_IDENTS, TEKKEN_IDENTS.get(t)) for i, t in enumerate(names))
    templates = (("<s>", "sequence_start"), ("</s>", "sequence_end"))
    return Definition("bytepair", tuple(vocab), chars=False, specials=marks, fallback=("unknown", "skip"), split=(regex(config["pattern"], "isolate"),), source="tekken", templates=templates).validated()


# SentencePiece -------------------------------------------------------------------------------------------------------------


def fields(data: bytes) -> list[tuple[int, Any]]:
    """(number, value) of a protobuf message; nested messages stay bytes."""
    out, at = [], 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        number, wire = tag >> 3, tag & 7
        if wire == 0:
            out.append((number, varint()))
        elif wire == 2:
            size = varint()
            if at + size > len(data):
                raise DefinitionError("the file is cut short")
            out.append((number, data[at : at + size]))
            at += size
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            out.append((number, struct.unpack_from("<d" if wire == 1 else "<f", data, at)[0]))
            at += size
        else:
            raise DefinitionError(f"wire type {wire}")
    return out


#: Field numbers of the trainer's special pieces (id, piece), with their defaults; the unknown one's text is field 44.
TRAINER_SPECIALS = {"unk": (40, 0, 45, b"<unk>"), "bos": (41, 1, 46, b"<s>"), "eos": (42, 2, 47, b"</s>"), "pad": (43, -1, 48, b"<pad>")}
UNKNOWN_SURFACE = " ⁇ ".encode()
#: The steps that normalizer names stand for.
NORMALIZERS = {"identity": (), "nfkc": ("NFKC",), "nmt_nfkc": ("NFKC", "nmt"), "nfkc_cf": ("NFKC", "casefold"), "nmt_nfkc_cf": ("NFKC", "nmt", "casefold")}


def from_sentencepiece(data: bytes) -> Definition:
    """Unigram and BPE models.  Pieces: 1 normal, 2 unknown, 3 control, 4 user defined, 5 unused, 6 byte."""
    try:
        body = fields(data)
    except IndexError as e:
        raise DefinitionError("not a protobuf file") from e
    pieces = [dict(fields(value)) for number, value in body if number == 1]
    if not pieces:
        raise DefinitionError("no pieces")
    part = lambda n: next((dict(fields(v)) for number, v in body if number == n), None)
    trainer, norm = part(2), part(3)
    kind = {1: "unigram", 2: "bytepair"}.get((trainer or {}).get(3, 1))
    if not kind:
        raise DefinitionError("only unigram and BPE pieces are known")
    # By text: a later piece takes the place of an earlier one, but a byte never that of a normal piece.
    marks: dict[bytes, Special] = {}
    templates: list[tuple[str, str]] = []
    unknown = None
    if trainer is not None:
        for name, (id_field, id_, text_field, text) in TRAINER_SPECIALS.items():
            i, text = trainer.get(id_field, id_) & 0xFFFFFFFF, trainer.get(text_field, text)
            shown = trainer.get(44, UNKNOWN_SURFACE) if name == "unk" else text
            marks[text] = Special(i, shown, "unknown" if name == "unk" else "control", 0.0, False, name)
            unknown = i if name == "unk" else unknown
            templates += [(text.decode(), "sequence_start" if name == "bos" else "sequence_end")] if name in ("bos", "eos") else []
    normal: dict[bytes, tuple[int, float, bool]] = {}
    for i, piece in enumerate(pieces):
        text, score, type_ = piece.get(1, b""), float(piece.get(2, 0.0)), int(piece.get(3, 1))
        if type_ == 6:
            found = re.fullmatch(rb"<0x([0-9A-Fa-f]{2})>", text)
            if not found:
                raise DefinitionError(f"piece {i} is no byte: {text!r}")
            text = bytes.fromhex(found[1].decode())
            if text in normal and not normal[text][2]:
                continue
        if type_ == 2 and unknown is None:
            marks[text], unknown = Special(i, text, "unknown", float(i), False, "unk"), i
        elif type_ in (3, 4):
            marks[text] = Special(i, text, "control" if type_ == 3 else "priority", float(i), False)
        elif type_ in (1, 6):
            normal[text] = (i, score, type_ == 6)
    fallback = (("bytes",) if (trainer or {}).get(35) else ()) + ("unknown", "skip")
    steps: list[Step] = []
    if norm is not None:
        name = norm.get(1, b"").decode()
        if name == "user_defined" and norm.get(2):
            steps.append(step("charsmap", blob=norm[2].hex()))
        elif name in NORMALIZERS:
            steps += [step("unicode", form=x) if x.startswith("NF") else step(x) for x in NORMALIZERS[name]]
        else:
            raise DefinitionError(f"normalizer {name!r} is not known, or lacks its map")
    suffix = bool((trainer or {}).get(24))
    left, right = (0, 1) if suffix else (1, 0)
    behaviour, processing, pattern = "merge_left" if suffix else "merge_right", (), "▁+"
    if (norm or {}).get(4, 1):  # remove_extra_whitespaces
        steps += [step("strip", ch=" ", left=ALL, right=ALL), step("collapse", ch=" ")]
        processing, pattern = ((step("collapse", id=unknown),) if unknown is not None else ()), "▁"
    split = (step("split", kind="regex", pattern=pattern, behaviour=behaviour),)
    steps.append(step("replace", old=" ", new="▁"))
    decoding = [step("replace", old="▁", new=" ")]
    if (norm or {}).get(3, 1):  # add_dummy_prefix
        steps.append(step("extend", ch="▁", left=left, right=right, pad=False))
        decoding.insert(0, step("strip", ch="▁", left=left, right=right))
    rows = [(i, t, score) for t, (i, score, _) in normal.items()]
    ranked = sorted(rows, key=lambda x: (x[2], x[0])) if kind == "unigram" else merge_order(rows)
    specials = tuple(Special(s.id, s.bytes, s.kind, 1 / (s.score + 1), False, s.ident) for s in marks.values())
    return Definition(
        kind, tuple((i, t) for i, t, _ in ranked), tuple(s for *_, s in ranked) if kind == "unigram" else (), True, 0, specials, fallback, tuple(steps), split, processing, tuple(decoding),
        source="sentencepiece", templates=tuple(templates),
    ).validated()


def merge_order(normal: list[tuple[int, bytes, float]]) -> list[tuple[int, bytes, float]]:
    """Tokens with a split into two tokens come by falling score, the others after them by id."""
    known = {t for _, t, _ in normal}
    merged = {t for t in known if any(t[:k] in known and t[k:] in known for k in range(1, len(t)))}
    return sorted((x for x in normal if x[1] in merged), key=lambda x: (-x[2], x[0])) + sorted(x for x in normal if x[1] not in merged)


# JSON tokenizers -----------------------------------------------------------------------------------------------------------


def byte_alphabet() -> dict[str, int]:
    """The byte that each printable stand-in means."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b != 173]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def _flat(node: dict | None, children: str) -> list[dict]:
    """Components in breadth-first order: a sequence's children join the end of the queue."""
    queue, out = deque([node] if node else []), []
    while queue:
        x = queue.popleft()
        if x["type"] == "Sequence":
            queue.extend(x[children])
        else:
            out.append(x)
    return out


def _pattern(p: Any) -> str:
    return p["Regex"] if isinstance(p, dict) and "Regex" in p else literal(p["String"] if isinstance(p, dict) else p)


#: Ideographs that are set apart, and punctuation (Unicode's, and what else ASCII prints).
CJK = "[\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}\\x{20000}-\\x{2A6DF}\\x{2A700}-\\x{2B73F}\\x{2B740}-\\x{2B81F}\\x{2B920}-\\x{2CEAF}\\x{F900}-\\x{FAFF}\\x{2F800}-\\x{2FA1F}]"
PUNCTUATION = "[\\x{0021}-\\x{002F}\\x{003A}-\\x{0040}\\x{005B}-\\x{0060}\\x{007B}-\\x{007E}\\p{P}]"
BEHAVIOUR = {"Removed": "remove", "Isolated": "isolate", "MergedWithPrevious": "merge_left", "MergedWithNext": "merge_right", "Contiguous": "merge"}


def _normalizer(x: dict) -> list[Step]:
    kind = x["type"]
    sub = lambda p, new: step("replace_regex", pattern=p, new=new)
    if kind == "BertNormalizer":
        out = [step("replace", old="\0", new=""), step("replace", old="�", new=""), sub(r"[\t\n\r]", " "), sub(r"\p{C}", ""), sub(r"\s", " ")] if x.get("clean_text", True) else []
        out += [sub(f"({CJK})", " $1 ")] if x.get("handle_chinese_chars", True) else []
        accents = x.get("strip_accents")
        out += [step("unicode", form="NFD"), sub(r"\p{Mn}", "")] if (x.get("lowercase", True) if accents is None else accents) else []
        return out + ([step("casefold")] if x.get("lowercase", True) else [])
    if kind in ("NFC", "NFD", "NFKC", "NFKD"):
        return [step("unicode", form=kind)]
    if kind in ("Strip", "StripNormalizer"):
        return ([sub(r"^\s+", "")] if x.get("strip_left", True) else []) + ([sub(r"\s+$", "")] if x.get("strip_right", True) else [])
    if kind == "StripAccents":
        return [sub(r"\p{M}", "")]
    if kind == "Lowercase":
        return [step("casefold")]
    if kind == "Nmt":
        return [step("nmt")]
    if kind == "Precompiled":
        return [step("charsmap", blob=base64.b64decode(x["precompiled_charsmap"]).hex())]
    if kind == "Replace":
        return [sub(_pattern(x["pattern"]), x["content"])]
    if kind == "Prepend":
        return [step("prepend", text=x["prepend"])]
    raise DefinitionError(f"unknown normalizer {kind}")


def prepending(x: dict) -> str:
    scheme = x.get("prepend_scheme", "always").lower()
    if x.get("add_prefix_space") is False and scheme != "never":
        raise DefinitionError("Metaspace that prepends and has add_prefix_space off")
    return scheme


def _pre_tokenizer(x: dict, state: dict) -> tuple[list[Step], list[Step]]:
    """Normalization and splits that the component stands for."""
    kind = x["type"]
    if kind == "BertPreTokenizer":
        return [], [regex(r"\s+", "remove"), regex(PUNCTUATION, "isolate")]
    if kind == "ByteLevel":
        state["bytes"] = True
        norm = [step("extend", ch=" ", left=1, right=0, pad=True)] if x.get("add_prefix_space", True) else []
        return norm, [regex(P50K, "isolate")] if x.get("use_regex", True) else []
    if kind == "CharDelimiterSplit":
        return [], [step("split", kind="char", pattern=x["delimiter"], behaviour="remove")]
    if kind == "Metaspace":
        mark = x.get("replacement", "▁")
        scheme = prepending(x)
        norm = [step("replace", old=" ", new=mark)]
        more = step("extend", ch=mark, left=1, right=0, pad=True)
        norm += [more] if scheme == "always" else [step("conditional", position="start", step={"name": more.name, "args": more.args})] if scheme == "first" else []
        return norm, [regex(f"{literal(mark)}+", "merge_right")] if x.get("split", True) else []
    if kind == "Whitespace":
        return [], [regex(r"\w+|[^\w\s]+", "match")]
    if kind == "WhitespaceSplit":
        return [step("replace_regex", pattern=r"\s+", new=" "), step("strip", ch=" ", left=ALL, right=ALL)], [step("split", kind="char", pattern=" ", behaviour="merge_right")]
    if kind == "Split":
        behaviour = BEHAVIOUR[x["behavior"]]
        return [], [regex(_pattern(x["pattern"]), "match" if x.get("invert") and behaviour == "remove" else behaviour)]
    if kind == "Punctuation":
        return [], [regex(PUNCTUATION, BEHAVIOUR[x.get("behavior", "Isolated")])]
    if kind == "Digits":
        return [], [regex(r"\p{N}", "isolate") if x.get("individual_digits") else regex(r"\p{N}+", "merge")]
    if kind == "UnicodeScripts":
        return [], [step("scripts")]
    raise DefinitionError(f"unknown pre-tokenizer {kind}")


def _decoder(x: dict, state: dict) -> list[Step]:
    kind = x["type"]
    if kind == "BPEDecoder":
        return [step("replace", old=x.get("suffix", "</w>"), new=" "), step("strip", ch=" ", left=0, right=ALL)]
    if kind in ("ByteLevel", "Fuse"):
        if kind == "ByteLevel" and not state.get("bytes"):
            raise DefinitionError("byte-level decoding without its pre-tokenizer")
        return []
    if kind == "ByteFallback":
        state["runes"] = True
        return []
    if kind == "WordPiece":
        out = [step("replace_regex", pattern=CLEANUP, new="$1"), step("replace", old=" do not", new=" don't")] if x.get("cleanup", True) else []
        return [*out, step("replace", old=x.get("prefix", "##"), new=""), step("strip", ch=" ", left=0, right=1)]
    if kind == "Metaspace":
        mark = x.get("replacement", "▁")
        first = [] if prepending(x) == "never" else [step("strip", ch=mark, left=1, right=0)]
        return [*first, step("replace", old=mark, new=" ")]
    if kind == "CTC":
        out = [step("replace", old=x.get("pad_token", "<pad>"), new="")]
        # The clean-up pattern is taken literally here, so it is never found.
        more = {CLEANUP: "$1", " ' ": "'", " do not": " don't", x.get("word_delimiter_token", "|"): " "} if x.get("cleanup", True) else {}
        return [*out, *(step("replace", old=a, new=b) for a, b in more.items())]
    if kind == "Replace":
        p = x["pattern"]
        return [step("replace_regex", pattern=p["Regex"], new=x["content"]) if isinstance(p, dict) and "Regex" in p else step("replace", old=p["String"] if isinstance(p, dict) else p, new=x["content"])]
    if kind == "Strip":
        return [step("strip", ch=x.get("content", " "), left=x.get("start", 0), right=x.get("stop", 0))]
    raise DefinitionError(f"unknown decoder {kind}")


def ident(text: str, kind: str) -> str | None:
    """What an added token is for, by its name."""
    if kind != "control":
        return "unk" if kind == "unknown" else None
    known = {"<startoftext>": "sot", "<endoftext>": "eot"}
    bracketed = text[:1] + text[-1:] in ("[]", "<>") and len(text) > 1
    return known.get(text) or (text.lstrip("<[").rstrip(">]").lower() if bracketed else None)


def _templates(x: dict, state: dict, some: bool) -> list[tuple[str, str]]:
    """Tokens around a text.  They are told to callers only: a special token of a post-processor that isn't an added token is none."""
    kind = x["type"]
    if kind in ("RobertaProcessing", "BertProcessing"):
        return [(x["sep"][0], "sequence_end"), (x["cls"][0], "sequence_start")]
    if kind == "ByteLevel":
        if not state.get("bytes"):
            raise DefinitionError("byte-level processing without its pre-tokenizer")
        return []
    if kind != "TemplateProcessing":
        raise DefinitionError(f"unknown post-processor {kind}")
    # Of a pair: what stands before, between and after the two texts; a token at two places belongs to each text.
    place: list[list[str]] = [[], [], []]
    at = 0
    for p in x.get("pair") or []:
        if "Sequence" in p:
            at = min(at + 1, 2)
        else:
            place[at].append(p["SpecialToken"]["id"])
    a, b, c = place
    out = [(t, "sequence_start") for t in a if t not in b] + [(t, "subsequence_start") for t in a if t in b]
    out += [(t, "sequence_continuation") for t in b if t not in a and t not in c] + [(t, "subsequence_end") for t in b if t in c]
    out += [(t, "sequence_end") for t in c if t not in b]
    single = x.get("single") or []
    if not (out or some):
        middle = next((i for i, p in enumerate(single) if "Sequence" in p), len(single))
        for i, p in enumerate(single):
            if "SpecialToken" in p:
                outer = i == 0 if i < middle else i == len(single) - 1
                out.append((p["SpecialToken"]["id"], ("" if outer else "sub") + ("sequence_start" if i < middle else "sequence_end")))
    return out


def from_tokenizers(data: bytes) -> Definition:
    body = json.loads(data)
    if "model" not in body:
        raise DefinitionError("no model")
    model, state = body["model"], {}
    norm = [s for x in _flat(body.get("normalizer"), "normalizers") for s in _normalizer(x)]
    split: list[Step] = []
    for x in _flat(body.get("pre_tokenizer"), "pretokenizers"):
        n, s = _pre_tokenizer(x, state)
        norm, split = norm + n, split + s
    templates: list[tuple[str, str]] = []
    for x in _flat(body.get("post_processor"), "processors"):
        templates += _templates(x, state, bool(templates))
    decoding = [s for x in _flat(body.get("decoder"), "decoders") for s in _decoder(x, state)]
    kind = model.get("type") or ("BPE" if "merges" in model else "WordPiece" if isinstance(model["vocab"], dict) else "Unigram")
    unknown = model.get("unk_token")
    scores: dict[int, float] = {}
    if kind == "Unigram":
        vocab = [(i, t) for i, (t, _) in enumerate(model["vocab"])]
        scores = {i: s for i, (_, s) in enumerate(model["vocab"])}
        unknown = model["vocab"][model["unk_id"]][0] if model.get("unk_id") is not None else None
    else:
        vocab = [(i, t) for t, i in model["vocab"].items()]
    merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
    made: dict[str, int] = {}
    for k, (a, b) in enumerate(merges):
        made.setdefault(a + b, k)
    named: dict[str, Special] = {}
    unknown_id = model.get("unk_id") if kind == "Unigram" else None
    for k, x in enumerate(body.get("added_tokens") or []):
        text = x["content"]
        name = "unknown" if text == unknown or unknown_id is not None and x["id"] == unknown_id else "control" if x.get("special") else "priority"
        named[text] = Special(x["id"], text.encode(), name, float(k), not x.get("normalized", False), ident(text, name))
    marks = list(named.values())
    if kind == "BPE":
        marks = [s for s in marks if s.kind != "priority" or len(s.bytes) > 1 and s.bytes.decode() not in made]
        vocab.sort(key=lambda x: (made.get(x[1], len(merges)), x[0]))
    elif kind == "Unigram":
        vocab.sort(key=lambda x: (scores[x[0]], x[0]))
    has_unknown = any(s.kind == "unknown" for s in marks)
    if (unknown is not None or kind == "WordPiece") and not has_unknown:
        raise DefinitionError(f"the unknown token {unknown!r} is not among the added tokens")
    gone = {s.bytes.decode() for s in marks}
    vocab = [x for x in vocab if x[1] not in gone]
    alphabet = byte_alphabet() if state.get("bytes") else None
    tokens: list[tuple[int, bytes]] = []
    seen: set[bytes] = set()
    plain = {t.encode() for _, t in vocab}
    for i, t in vocab:
        raw = bytes(alphabet[c] for c in t) if alphabet and all(c in alphabet for c in t) else t.encode()
        if (state.get("runes") or model.get("byte_fallback")) and (m := re.fullmatch(r"<0x([0-9A-Fa-f]{2})>", t)) and bytes.fromhex(m[1]) not in plain:
            raw = bytes.fromhex(m[1])
        if kind == "WordPiece" or raw not in seen:
            seen.add(raw)
            tokens.append((i, raw))
    # A special token with the id of another token gets the next id above the vocabulary.
    ids = {i for i, _ in vocab}
    following = max(ids, default=0) + 1
    fixed = []
    for s in sorted(marks, key=lambda s: s.order):
        if kind == "BPE" and s.id in ids:
            s, following = Special(following, s.bytes, s.kind, s.score, s.extract, s.ident), following + 1
        fixed.append(s)
    fallback = (("bytes",) if model.get("byte_fallback") and not (kind == "BPE" and alphabet) and kind != "WordPiece" else ()) + (("unknown",) if has_unknown else ()) + ("skip",)
    processing: list[Step] = []
    unk_id = next((s.id for s in sorted(fixed, key=lambda s: s.order) if s.kind == "unknown"), None)
    if unk_id is not None and (kind == "Unigram" or kind == "BPE" and model.get("fuse_unk")):
        processing.append(step("collapse", id=unk_id))
    if (p := body.get("padding")) and isinstance(p.get("strategy"), dict):
        processing.append(step("pad", id=p["pad_id"], length=p["strategy"]["Fixed"], stride=p.get("pad_to_multiple_of") or 1, left=p.get("direction") == "Left"))
    if t := body.get("truncation"):
        processing.append(step("truncate", length=t["max_length"], stride=t.get("stride") or 1, left=t.get("direction") == "Left"))
    name = {"BPE": "bytepair", "Unigram": "unigram", "WordPiece": "wordpiece"}[kind]
    return Definition(
        name, tuple(tokens), tuple(scores[i] for i, _ in tokens) if kind == "Unigram" else (), not alphabet, model.get("max_input_chars_per_word", 0) if kind == "WordPiece" else 0,
        tuple(fixed), fallback, tuple(norm), tuple(split), tuple(processing), tuple(decoding), model.get("end_of_word_suffix") or "", (model.get("continuing_subword_prefix") or "") if kind == "WordPiece" else "", "tokenizers", templates=tuple(templates),
    ).validated()


# Own format and detection --------------------------------------------------------------------------------------------------

MAGIC = b"TLDEF001"


def to_bytes(d: Definition) -> bytes:
    return MAGIC + d.to_json().encode()


def from_native(data: bytes) -> Definition:
    if data[: len(MAGIC)] != MAGIC:
        raise DefinitionError("not a definition")
    return Definition.from_json(data[len(MAGIC) :].decode())


FORMATS = {"native": from_native, "tiktoken": from_tiktoken, "sentencepiece": from_sentencepiece, "tokenizers": from_tokenizers, "tekken": from_tekken}


def from_bytes(data: bytes, format: str | None = None) -> Definition:
    """By the named format, or by the first one that reads the data."""
    if format:
        return FORMATS[format](data)
    for read in FORMATS.values():
        try:
            return read(data)
        except (ValueError, KeyError, TypeError, IndexError, struct.error):
            continue
    raise DefinitionError("no known format reads this")


def hub_url(name: str) -> str:
    """hf:owner/name stands for that repository's tokenizer file; other addresses stay."""
    return f"https://huggingface.co/{name[3:]}/resolve/main/tokenizer.json" if name.startswith("hf:") else name


def from_web(name: str) -> Definition:
    """What an address holds; the definition's source is then the address."""
    url = hub_url(name)
    if not url.startswith(("http:", "https:")):
        raise DefinitionError(f"no web address: {url}")
    from urllib.request import urlopen

    with urlopen(url) as answer:
        return replace(from_bytes(answer.read()), source=url)


def load(spark, path: str, format: str | None = None) -> Definition:
    """Reads a file from any store that Spark reads, or from the web."""
    if path.startswith(("hf:", "http:", "https:")):
        return from_web(path)
    return from_bytes(bytes(spark.read.format("binaryFile").load(path).first()["content"]), format)
