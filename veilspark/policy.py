"""Settings of a scan. Everything here is small and lives on the driver."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from datetime import UTC, date, datetime

SEVERITIES = ("info", "low", "medium", "high", "critical")
RANK = {name: i for i, name in enumerate(SEVERITIES)}


def severity_rank(name: str) -> int:
    try:
        return RANK[name.strip().lower()]
    except KeyError:
        raise ValueError(f"unknown severity {name!r} (use one of {', '.join(SEVERITIES)})") from None


# --- fixed values: default path filters ----------------------------------------
DEFAULT_INCLUDE = ("**/*",)
DEFAULT_EXCLUDE = (
    ".git/**", "node_modules/**", "dist/**", "build/**", "coverage/**",
    *(f"**/*.{ext}" for ext in (
        "svg png jpg jpeg gif webp ico icns avif bmp tif tiff mp4 m4v mov webm mkv avi ogv mp3 m4a wav flac aac "
        "ogg opus woff woff2 ttf otf eot"
    ).split()),
)


@dataclass(frozen=True)
class CustomRule:
    id: str
    pattern: str
    severity: str = "high"
    kind: str = "internal"
    message: str | None = None
    confidence: float | None = 1.0
    case_insensitive: bool = False
    enabled: bool = True

    @property
    def effective_kind(self) -> str:
        return self.kind.strip() or "internal"

    @property
    def java_pattern(self) -> str:
        flags = "(?iu)" if self.case_insensitive else ""
        return "(?d)" + flags + self.pattern

    def check(self) -> None:
        """Reject rules that cannot work, before any job starts."""
        if not self.id.strip():
            raise ValueError("custom rule id must not be empty")
        if not self.pattern.strip():
            raise ValueError(f"custom rule {self.id!r}: pattern must not be empty")
        severity_rank(self.severity)
        try:
            empty = re.match(self.pattern, "")
        except re.error:
            empty = None  # Java syntax Python lacks; the engine reports real errors
        if empty is not None:
            raise ValueError(f"custom rule {self.id!r}: pattern must not match empty text")


@dataclass(frozen=True)
class AllowEntry:
    """One allowlist row: which findings are accepted, where and until when."""

    rule_id: str | None = None
    path: str = "**/*"
    value_hash: str | None = None
    reason: str | None = None
    expires: str | None = None
    unknown: tuple[str, ...] = ()

    def expiry_date(self) -> date | None:
        try:
            return datetime.strptime((self.expires or "").strip(), "%Y-%m-%d").date()
        except ValueError:
            return None

    def expired(self, today: date | None = None) -> bool:
        """Past its date, or with a date that cannot be read."""
        if self.expires is None:
            return False
        until = self.expiry_date()
        return until is None or until < (today or datetime.now(UTC).date())


@dataclass(frozen=True)
class MaskSettings:
    redaction: str = "match"        # match | full | partial
    preserve_prefix: int = 0
    preserve_suffix: int = 0
    min_severity: str = "medium"

    def __post_init__(self) -> None:
        if self.redaction not in ("match", "full", "partial"):
            raise ValueError(f"unsupported redaction {self.redaction!r} (use match, full or partial)")
        severity_rank(self.min_severity)


@dataclass(frozen=True)
class PseudonymizeSettings:
    token_bits: int = 64
    email_strip_subaddress: bool = False
    columns: Mapping[str, str] = field(default_factory=dict)
    rules: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Policy:
    secrets: bool = True
    pii: bool = True
    pii_languages: tuple[str, ...] = ("en", "ja")
    env: bool = True
    ai_context: bool = True
    internal_terms: bool = False
    custom_rules: tuple[CustomRule, ...] = ()
    allowlist: tuple[AllowEntry, ...] = ()
    include: tuple[str, ...] = DEFAULT_INCLUDE
    exclude: tuple[str, ...] = DEFAULT_EXCLUDE
    max_file_size_bytes: int = 1 << 20
    binary_detection_bytes: int = 8 << 10
    fail_on: str = "high"
    ignore_keyword: str = "scan-ignore"
    apply_suppressions: bool = True
    mask: MaskSettings = MaskSettings()
    pseudonymize: PseudonymizeSettings = PseudonymizeSettings()
    guard_profile: str = "recommended"
    guard_allow: tuple[str, ...] = ()
    guard_deny: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        severity_rank(self.fail_on)
        for number, entry in enumerate(self.allowlist, 1):
            if entry.rule_id is None and entry.value_hash is None and entry.path == "**/*" and entry.unknown:
                raise ValueError(
                    f"allowlist entry {number} has no selector and would suppress every finding in every file"
                )

    def active_custom_rules(self) -> list[CustomRule]:
        rules = [
            r for r in self.custom_rules
            if r.enabled and (self.internal_terms or r.effective_kind.lower() != "internal")
        ]
        for rule in rules:
            rule.check()
        return rules

    # -- loading -----------------------------------------------------------

    @classmethod
    def from_dict(cls, raw: Mapping) -> Policy:
        """Build a policy from the nested sections of a configuration file."""
        scan, rules = raw.get("scan", {}), raw.get("rules", {})
        flat: dict = {k: rules[k] for k in ("secrets", "pii", "env", "ai_context", "internal_terms") if k in rules}
        if "pii_languages" in rules:
            flat["pii_languages"] = tuple(rules["pii_languages"])
        for key in ("include", "exclude"):
            if key in scan:
                flat[key] = tuple(scan[key])
        for key in ("max_file_size_bytes", "binary_detection_bytes", "ignore_keyword"):
            if key in scan:
                flat[key] = scan[key]
        if "scan_fail_on" in raw.get("thresholds", {}):
            flat["fail_on"] = raw["thresholds"]["scan_fail_on"]
        flat["mask"] = MaskSettings(**_known(MaskSettings, raw.get("mask", {})))
        flat["pseudonymize"] = PseudonymizeSettings(**_known(PseudonymizeSettings, raw.get("pseudonymize", {})))
        guard = raw.get("action_guard", {})
        for key, name in (("profile", "guard_profile"), ("allow", "guard_allow"), ("deny", "guard_deny")):
            if key in guard:
                flat[name] = tuple(guard[key]) if name != "guard_profile" else guard[key]
        flat["custom_rules"] = tuple(
            CustomRule(**_known(CustomRule, r)) for r in raw.get("custom_rules", [])
        )
        entries = []
        known = {f.name for f in fields(AllowEntry)} - {"unknown"}
        for number, row in enumerate(raw.get("allowlist", []), 1):
            if not {"rule_id", "value_hash", "path"} & set(row):
                raise ValueError(
                    f"allowlist entry {number} has no selector and would suppress every finding in every file; "
                    "set at least one of rule_id, value_hash, path"
                )
            entries.append(AllowEntry(
                **{k: v for k, v in row.items() if k in known}, unknown=tuple(sorted(set(row) - known))
            ))
        flat["allowlist"] = tuple(entries)
        return cls(**flat)

    @classmethod
    def load(cls, path: str | None) -> Policy:
        """Read TOML or JSON settings; defaults when there is no file."""
        if path is None:
            return cls()
        try:
            with open(path, "rb") as handle:
                data = handle.read().decode()
        except FileNotFoundError:
            return cls()
        return cls.from_dict(json.loads(data) if path.endswith(".json") else tomllib.loads(data))


def _known(cls, raw: Mapping) -> dict:
    names = {f.name for f in fields(cls)}
    return {k: v for k, v in raw.items() if k in names}
