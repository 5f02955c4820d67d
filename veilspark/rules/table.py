"""The rule catalogue: every built-in and custom rule in engine order."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from ..policy import Policy, severity_rank
from . import dialect, providers, tuned

# Rules without a gate although they carry keywords: what they match can be
# shorter than a gate asks for, or they are limited to few paths.
UNGATED = {
    "curl-auth-header", "curl-auth-user", "freemius-secret-key", "hashicorp-tf-password", "jwt-base64",
    "kubernetes-secret-yaml", "nuget-config-password", "private-key", "slack-app-token", "slack-legacy-token",
    "slack-legacy-workspace-token",
    "secret.database_url", "secret.generic_api_key", "secret.private_key_block",
}
_LABELLED = {row[0] for row in providers.LABELLED + providers.LABELLED_EXACT_VALUE} | {"sonar-api-token"}


def _provider_gate(name: str) -> str | None:
    if name in UNGATED:
        return None
    return "label" if name in _LABELLED else "run"


def _tuned_gate(rule: tuned.Tuned) -> str | None:
    if rule.rule_id in UNGATED:
        return None
    if rule.kind == tuned.SECRET or rule.rule_id == "pii.plaintext_map":
        return "run"
    if rule.literals and all(ord(ch) > 127 for word in rule.literals for ch in word):
        return "cjk"
    return None


@dataclass(frozen=True)
class Rule:
    rule_id: str
    key: str
    severity: str
    kind: str
    message: str
    confidence: float
    java: str
    re2: str
    source: str                          # tuned | provider | ai | custom
    literals: tuple[str, ...] = ()       # lower-case; one must occur
    gate: str | None = None              # run | label | cjk: document test made once for many rules
    shape: str | None = None             # cheap Java pattern; must occur
    folds_case: bool = False             # (?i) with Unicode folding
    non_ascii: bool = False              # can only match non-ASCII text
    path_java: str | None = None
    env_paths: bool = False
    entropy: float | None = None
    secret_group: int | None = None
    lead: str | None = None
    allow: tuple[providers.Allow, ...] = ()
    line_java: str | None = None         # superset for line-by-line use

    @property
    def rank(self) -> int:
        return severity_rank(self.severity)

    @property
    def by_line(self) -> bool:
        """Every match lies in one line, and that line holds one of the literals, which are no letters."""
        signs = bool(self.literals) and all(w.lower() == w.upper() for w in self.literals)
        return signs and self.source == "tuned" and dialect.one_line(self.re2)


def _linear(rule: tuned.Tuned, java: str) -> str:
    if rule.run:
        java = dialect.from_run_start(java, rule.run)
    return dialect.after_blank_lines(java) if rule.pattern.startswith(dialect.BLANK_LINES) else java


def _tuned() -> list[Rule]:
    out = []
    for r in tuned.RULES:
        out.append(Rule(
            r.rule_id, r.rule_id.replace(".", "_"), r.severity, r.kind, r.message, r.confidence,
            _linear(r, dialect.to_java(r.pattern)), dialect.to_re2(r.pattern), "tuned",
            literals=tuple(x.lower() for x in r.literals), gate=_tuned_gate(r),
            shape=dialect.to_java(r.shape) if r.shape else None,
            folds_case="(?i" in r.pattern, env_paths=r.kind == tuned.ENV,
            line_java=_linear(r, dialect.line_superset(r.pattern)),
        ))
    return out


def _providers() -> list[Rule]:
    out = []
    for r in providers.build():
        out.append(Rule(
            providers.PREFIX + r.name, "provider_" + r.name.replace("-", "_"), "high", "secret",
            f"Possible credential ({r.name.replace('-', ' ')})", 0.82 if r.entropy is None else 0.88,
            dialect.to_java(r.pattern), dialect.to_re2(r.pattern), "provider",
            literals=r.keywords, gate=_provider_gate(r.name), path_java=dialect.to_java(r.path) if r.path else None,
            entropy=r.entropy, secret_group=r.secret_group,
            lead=dialect.to_java(r.lead) if r.lead else None, allow=r.allow,
            line_java=dialect.line_superset(r.pattern),
        ))
    return out


def _ai() -> list[Rule]:
    return [
        Rule(
            r.rule_id, "ai_" + r.key, r.severity, "ai-context", r.message, r.confidence,
            dialect.to_java(r.pattern), dialect.to_re2(r.pattern), "ai",
            literals=tuple(x.lower() for x in r.literals), folds_case="(?i" in r.pattern,
            non_ascii="(?i" not in r.pattern, line_java=dialect.line_superset(r.pattern),
        )
        for r in tuned.AI_CONTEXT
    ]


@lru_cache(maxsize=1)
def builtin() -> tuple[Rule, ...]:
    return tuple(_tuned() + _providers() + _ai())


def _custom(policy: Policy) -> list[Rule]:
    out = []
    for r in policy.active_custom_rules():
        confidence = 1.0 if r.confidence is None or r.confidence != r.confidence else min(max(r.confidence, 0.0), 1.0)
        out.append(Rule(
            r.id.strip(), r.id.strip(), r.severity.lower(), r.effective_kind,
            (r.message or "").strip() or "Custom sensitive term detected", confidence,
            r.java_pattern, r.pattern, "custom",
        ))
    return out


def enabled(rule: Rule, policy: Policy) -> bool:
    """Rule gate by kind, id prefix and language."""
    if rule.source == "custom":
        return True
    if rule.kind == "env" and not policy.env:
        return False
    if rule.source == "ai" and not policy.ai_context:
        return False
    if rule.rule_id.startswith("secret.") and not policy.secrets:
        return False
    if rule.rule_id.startswith("pii."):
        if not policy.pii:
            return False
        language = rule.rule_id.split(".")[1]
        if language in ("en", "ja") and language not in policy.pii_languages:
            return False
    return True


def rules_for(policy: Policy) -> list[Rule]:
    return [r for r in builtin() if enabled(r, policy)] + _custom(policy)
