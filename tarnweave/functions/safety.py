"""Redaction, predicates on unsafe text, and risk grades, as column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnweave.functions.text import bind

LABEL = "[redacted]"
# What follows are fixed values: patterns that texts are judged by. Replacements keep group 1 and 2.
#: Secrets in text, in order.
SECRET_RULES = [
    (r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?(?:-----END [A-Z ]*PRIVATE KEY-----|\z)", LABEL),
    (r"(?i)\b([\w.-]*(?:pass(?:word|wd)?|pwd|secret|token|api[_-]?key|access[_-]?key|credential|authorization)[\w.-]*)(\s*[:=]\s*)(?:bearer\s+|basic\s+)?[\"']?[^\s\"',;]+", rf"$1$2{LABEL}"),
    (r"(?i)\b(password|passwd|pwd)\s+(?!authentication|auth\b|required|incorrect|expired|is\b|was\b|for\b|in\b|of\b|and\b|or\b|not\b|may\b|must\b)\S{4,}", rf"$1 {LABEL}"),
    (r"(令牌|密钥|私钥|口令|密码|凭证)\s*(?:[:：=]|是|为)\s*(?![?？]|什么|啥|哪个|如何|怎么)[^\s，。！？；、]+", rf"$1：{LABEL}"),
    (r"(?i)\bbearer\s+[A-Za-z0-9._~+/=-]{8,}", f"Bearer {LABEL}"),
    (r"\bsk-[A-Za-z0-9_-]{8,}", LABEL),
    (r"\b(?:gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,})\b", LABEL),
    (r"\bAKIA[A-Z0-9]{16}\b", LABEL),
    (r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b", LABEL),
    (r"(://[^:/\s@]+:)[^@\s]+@", rf"$1{LABEL}@"),
]
#: A sign that must be in a text for the rule at that place to fit; empty where there is none.
SECRET_SIGNS = [("PRIVATE KEY",), (":", "="), (), ("令牌", "密钥", "私钥", "口令", "密码", "凭证"), ("earer", "EARER"), ("sk-",), ("gh", "github_pat_"), ("AKIA",), ("eyJ",), ("://",)]
#: Secrets and local places in evaluation reports, in order.
REPORT_RULES = [
    (r"-----BEGIN(?: [A-Z]+)? PRIVATE KEY-----[\s\S]*?(?:-----END(?: [A-Z]+)? PRIVATE KEY-----|$)", LABEL),
    (r"(?i)(?:[A-Z]:\\|\\\\)[^\r\n\"']+", LABEL),
    (r"(?i)(?:/home/|/users/|/tmp/|/var/tmp/)[^\r\n\"']+", LABEL),
    (r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]+", f"Bearer {LABEL}"),
    (r"\bsk-[A-Za-z0-9_-]{12,}\b", LABEL),
    (r"(?i)\b(?:ghp|github_pat)_[A-Za-z0-9_]{16,}\b", LABEL),
    (r"\bAKIA[0-9A-Z]{16}\b", LABEL),
    (r"(?i)\b(password|passwd|secret|api[_-]?key|token)\s*[:=]\s*([^\s,;]+)", rf"$1={LABEL}"),
]
SECRET_KEY = r"(?i)(?:password|passwd|secret|api[_-]?key|access[_-]?key|token|auth(?:orization)?|cookie|private[_-]?key)"
COUNTING_KEYS = ("prompt_tokens", "completion_tokens", "total_tokens")
#: Text that tries to steer an agent.
INSTRUCTION = (
    r"(?:忽略|无视|绕过|覆盖).{0,12}(?:规则|指令|提示词|限制|策略|系统)"
    r"|(?:ignore|disregard|bypass|override).{0,24}(?:instruction|rule|prompt|polic)"
    r"|(?:系统提示词|system prompt)"
    r"|(?:不需要|不用|无需|不必)(?:再)?(?:询问|告知|确认|通知|审批|经过)"
    r"|(?:直接|立刻|立即|必须先?|务必)(?:\S{0,6})(?:删除|清空|结束|杀掉|格式化|执行|运行)"
    r"|AI\s*(?:助手|维护|agent)|\[?OPS-NOTE\]?|始终同意|always (?:approve|agree)"
)
#: Injections by name.
INJECTIONS = {
    "instruction-override": r"(?:ignore|disregard)\s+(?:all\s+)?(?:previous|prior|system)\s+instructions?",
    "instruction-override-zh": r"(?:忽略|无视|不要遵守)(?:之前|先前|系统|以上)?(?:的)?(?:指令|提示|规则)",
    "prompt-disclosure": r"(?:reveal|print|show)\s+(?:the\s+)?(?:system\s+)?prompt",
    "prompt-disclosure-zh": r"(?:显示|泄露|输出)(?:系统)?(?:提示词|系统提示)",
    "role-override": r"\byou\s+are\s+now\b",
    "role-override-zh": r"你现在是",
}
#: Credentials in an answer by name.
CREDENTIALS = {
    "private-key": r"-----BEGIN(?: [A-Z]+)? PRIVATE KEY-----",
    "api-key": r"\bsk-(?:proj-)?[A-Za-z0-9_-]{16,}\b",
    "github-token": r"\b(?:ghp|github_pat)_[A-Za-z0-9_]{16,}\b",
    "authorization": r"\b(?:authorization\s*:\s*bearer|bearer)\s+[A-Za-z0-9._~+/=-]{16,}",
    "credential-assignment": r"\b(?:api[_-]?key|token|password|secret)\s*[=:]\s*['\"]?[A-Za-z0-9._~+/=-]{12,}",
}
#: Credentials in a report that keep a release back, names of fields that hold one, and what replaces them; fixed values.
GATE_CREDENTIALS = (
    r"-----BEGIN(?: [A-Z]+)? PRIVATE KEY-----",
    r"\b(?:sk-(?:proj-)?|[rps]k_)[A-Za-z0-9_-]{16,}\b",
    r"(?i)\b(?:ghp|github_pat)_[A-Za-z0-9_]{16,}\b",
    r"\bAKIA[0-9A-Z]{16}\b",
    r"(?i)\b(?:authorization\s*:\s*bearer|bearer)\s+[A-Za-z0-9._~+/=-]{16,}",
    r"(?i)\b(?:api[_-]?key|token|password|secret)\s*[=:]\s*['\"]?[A-Za-z0-9._~+/=-]{12,}",
)
GATE_SECRET_KEY = r"(?i)(?:api[_-]?key|access[_-]?token|auth(?:orization)?|password|secret|private[_-]?key)"
GATE_LABEL = "[REDACTED]"
#: Commands of an answer that need a warning, by name.
UNSAFE_COMMANDS = {
    "recursive-force-delete": r"\brm\s+[^\n]*(?:-rf|-fr|--recursive[^\n]*--force)",
    "hard-reset": r"\bgit\s+reset\s+--hard\b",
    "force-push": r"\bgit\s+push\b[^\n]*(?:--force|-f)\b",
    "destructive-sql": r"\b(?:drop|truncate)\s+(?:table|database|schema)\b",
    "pipe-to-shell": r"\bcurl\b[^\n|]*\|\s*(?:sudo\s+)?(?:sh|bash)\b",
    "windows-force-delete": r"\b(?:remove-item|del|erase|rmdir)\b[^\n]*(?:-recurse|-force|/f|/s)\b",
}
#: Commands that cannot be undone, and commands that change something.
HIGH_RISK = {
    "recursive_delete": r"\brm\s+[^\n]*-[a-zA-Z]*r[a-zA-Z]*f|\brm\s+[^\n]*-[a-zA-Z]*f[a-zA-Z]*r",
    "git_reset_hard": r"\bgit\s+reset\s+--hard\b",
    "git_force_push": r"\bgit\s+push\b[^\n]*(?:--force(?:-with-lease)?|-f)\b",
    "drop_object": r"\b(?:drop|truncate)\s+(?:table|database|schema)\b",
    "docker_prune": r"\bdocker\s+(?:system|volume|image|container)\s+prune\b",
    "kubectl_delete": r"\bkubectl\s+delete\b",
    "pipe_to_shell": r"\bcurl\b[^\n|]*\|\s*(?:sudo\s+)?(?:sh|bash)\b",
    "windows_delete": r"\b(?:remove-item|del|erase|rmdir)\b[^\n]*(?:-recurse|-force|/f|/s)\b",
    "mirror_copy": r"\brobocopy\b[^\n]*/mir\b",
    "force_kill": r"\btaskkill\b[^\n]*/f\b",
}
MEDIUM_RISK = {
    "sudo": r"(^|\s)sudo\s+",
    "git_clean": r"\bgit\s+clean\b|\bgit\s+branch\s+-D\b",
    "docker_remove": r"\bdocker\s+(?:rm|rmi)\b",
    "delete_rows": r"\bdelete\s+from\b",
    "move_copy": r"\b(?:copy-item|move-item|copy|move)\b",
    "service": r"\b(?:stop-process|stop-service|restart-service|sc\.exe\s+(?:stop|start))\b",
    "install": r"\b(?:winget|choco|scoop)\s+(?:install|upgrade)\b",
    "archive": r"\b(?:compress-archive|expand-archive)\b",
}


def _rule(pattern: str, new: str, signs: tuple[str, ...]):
    """A rule that only runs on texts with a sign it needs, which is cheaper to look for."""
    has = lambda t: reduce(lambda a, x: a | F.contains(t, F.lit(x)), signs, F.lit(not signs))
    return lambda t: F.when(has(t), F.regexp_replace(t, pattern, new)).otherwise(t)


def redact(text: Column) -> Column:
    """Secrets written over."""
    for (pattern, new), signs in zip(SECRET_RULES, SECRET_SIGNS, strict=True):
        text = bind(text, _rule(pattern, new, signs))
    return text


def redact_report(text: Column) -> Column:
    """Secrets and local paths of an evaluation report written over."""
    return reduce(lambda t, r: F.regexp_replace(t, r[0], r[1]), REPORT_RULES, text)


def is_secret_key(key: Column) -> Column:
    """Whether a field of that name holds a secret; counts of tokens do not."""
    return key.rlike(SECRET_KEY) & ~F.lower(key).isin(*COUNTING_KEYS)


def is_sensitive(text: Column, rules=SECRET_RULES) -> Column:
    return reduce(lambda a, r: a | text.rlike(r[0]), rules, F.lit(False))


def looks_like_instruction(text: Column) -> Column:
    return text.rlike("(?i)" + INSTRUCTION)


def findings(text: Column, rules: dict[str, str] = HIGH_RISK) -> Column:
    """Names of the rules that match, in their order."""
    return F.filter(F.array(*[F.when(text.rlike("(?i)" + p), F.lit(n)) for n, p in rules.items()]), lambda x: x.isNotNull())


def risk(code: Column) -> Column:
    """high if any high rule matches, else medium if any medium rule does, else low."""
    any_of = lambda rules: reduce(lambda a, p: a | code.rlike("(?i)" + p), rules.values(), F.lit(False))
    return F.when(any_of(HIGH_RISK), "high").when(any_of(MEDIUM_RISK), "medium").otherwise("low")


def refusal(text: Column) -> Column:
    """Why a request is refused, by the first rule that fits; else null."""
    asks = text.rlike(r"(?i)(?:show|give|tell|print|reveal)\b.{0,30}\b(?:password|token|secret|credential|api key)")
    return F.when(asks, "credential_request").when(looks_like_instruction(text), "prompt_injection")


def intent(text: Column) -> Column:
    """template, compare, document_lookup or command by keyword, in this order; else knowledge."""
    has = lambda *w: reduce(lambda a, x: a | F.contains(F.lower(text), F.lit(x)), w, F.lit(False))
    return (
        F.when(has("template", "模板", "boilerplate"), "template").when(has("compare", "difference between", " vs ", "区别", "对比"), "compare")
        .when(has("document", "manual", "according to", "文档"), "document_lookup").when(has("command", "how do i run", "how to run", "命令"), "command")
        .otherwise("knowledge")
    )


def leak_paths(json: Column, keys: list[str]) -> Column:
    """The keys of a flat JSON object whose string form looks like a credential."""
    return F.filter(
        F.array(*[F.when(F.coalesce(is_sensitive(F.concat(F.lit(f"{k}="), F.get_json_object(json, f"$.{k}"))), F.lit(False)), F.lit(f"$.{k}")) for k in keys]),
        lambda x: x.isNotNull(),
    )
