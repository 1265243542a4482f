"""Detector rules. A rule set is a short Python list, so it compiles into the plan as literals."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    rule_id: str
    detector: str
    category: str
    pattern: str
    severity: str
    confidence: float
    rationale: str
    recommendation: str
    #: Lower-case text that every match holds: one of each group. Empty: not known, the pattern alone decides.
    words: tuple[tuple[str, ...], ...] = ()


# The six prompt-injection rules (patterns, weights and wording must match).
PROMPT_INJECTION_RULES = (
    Rule(
        "pi_instruction_override_001",
        "prompt_injection",
        "instruction_override",
        r"\b(ignore|disregard|override|bypass)\b.{0,60}\b(previous|prior|above|system|developer|safety)\b.{0,30}\b(instructions?|rules?|message)\b",
        "high",
        0.9,
        "Text appears to ask the model to override higher-priority instructions.",
        "Quarantine or review this source before exposing it to an agent context.",
        (("ignore", "disregard", "override", "bypass"), ("previous", "prior", "above", "system", "developer", "safety"), ("instruction", "rule", "message")),
    ),
    Rule(
        "pi_secret_exfiltration_001",
        "prompt_injection",
        "secret_exfiltration",
        r"\b(reveal|print|dump|send|exfiltrate|upload)\b.{0,80}\b(secrets?|tokens?|api[_ -]?keys?|credentials?|passwords?)\b",
        "critical",
        0.92,
        "Text appears to request disclosure or transfer of secrets or credentials.",
        "Block the source from agent context and inspect the surrounding artifact.",
        (("reveal", "print", "dump", "send", "exfiltrate", "upload"), ("secret", "token", "key", "credential", "password")),
    ),
    Rule(
        "pi_tool_misuse_001",
        "prompt_injection",
        "tool_misuse",
        r"\b(call|invoke|use|run|execute)\b.{0,80}\b(shell|exec|terminal|curl|wget|delete|rm -rf|filesystem write)\b",
        "high",
        0.86,
        "Text appears to steer the agent toward risky tool use unrelated to normal documentation.",
        "Require human review before allowing tool execution based on this content.",
        (("shell", "exec", "terminal", "curl", "wget", "delete", "rm -rf", "filesystem write"), ("call", "invoke", "use", "run", "execute")),
    ),
    Rule(
        "pi_authority_impersonation_001",
        "prompt_injection",
        "authority_impersonation",
        r"\b(system|developer|admin|root)\b.{0,40}\b(says|message|instruction|requires|orders)\b",
        "high",
        0.84,
        "Text appears to impersonate a higher-priority authority channel.",
        "Treat this content as untrusted data and do not follow its claimed authority.",
        (("system", "developer", "admin", "root"), ("says", "message", "instruction", "requires", "orders")),
    ),
    Rule(
        "pi_persistence_manipulation_001",
        "prompt_injection",
        "persistence_manipulation",
        r"\b(remember|store|persist|always follow|from now on)\b.{0,80}\b(this instruction|these instructions|this rule|future requests?)\b",
        "medium",
        0.82,
        "Text appears to ask the model to retain or prioritize attacker-controlled behavior.",
        "Strip or isolate this content from any long-lived agent memory.",
        (("this instruction", "these instructions", "this rule", "future request"), ("remember", "store", "persist", "always follow", "from now on")),
    ),
    Rule(
        "pi_suspicious_formatting_001",
        "prompt_injection",
        "suspicious_formatting",
        "(<!--.*?(ignore|disregard|override).*?-->|[\\x{200b}\\x{200c}\\x{200d}\\x{feff}])",
        "medium",
        0.8,
        "Text contains hidden or obfuscated formatting often used to conceal instructions.",
        "Render and review the raw source before trusting this artifact.",
        (("<!--", "\u200b", "\u200c", "\u200d", "\ufeff"),),
    ),
)

# Our own rules for the two detectors whose rule text is not published: what counts as a
# credential reference or a permission signal follows the public annotation guidelines.
CREDENTIAL_PERMISSION_RULES = (
    Rule(
        "cr_secret_assignment_001",
        "credential_reference",
        "credential_reference",
        r"\b(api[_ -]?key|secret|token|password|credential)s?\b\s*[:=]\s*[\"']?[a-z0-9_/+-]{8,}",
        "high",
        0.85,
        "Text appears to contain a secret or token value.",
        "Remove the value, rotate the credential and review who could read it.",
        (("key", "secret", "token", "password", "credential"), (":", "=")),
    ),
    Rule(
        "cr_env_var_001",
        "credential_reference",
        "credential_reference",
        r"\b[a-z][a-z0-9]*_(key|token|secret|password)\b",
        "low",
        0.7,
        "Text refers to a credential-bearing environment variable.",
        "Check that the tool needs this credential and that its scope is minimal.",
        (("_key", "_token", "_secret", "_password"),),
    ),
    Rule(
        "ps_filesystem_write_001",
        "permission_signal",
        "permission_overreach",
        r"\b(write|delete|modify|overwrite)\b.{0,40}\b(files?|filesystem|director(y|ies)|disk|logs)\b",
        "medium",
        0.75,
        "Text describes filesystem write access.",
        "Confirm that write access is part of the stated purpose of the tool.",
        (("write", "delete", "modify"), ("file", "director", "disk", "logs")),
    ),
    Rule(
        "ps_message_send_001",
        "permission_signal",
        "permission_overreach",
        r"\b(send|post)\b.{0,40}\b(emails?|messages?|webhook|callback)\b",
        "medium",
        0.7,
        "Text describes sending messages outside the agent.",
        "Confirm that outbound messages are part of the stated purpose of the tool.",
        (("send", "post"), ("email", "message", "webhook", "callback")),
    ),
    Rule(
        "ps_network_access_001",
        "permission_signal",
        "permission_overreach",
        r"\b(network|internet|outbound)\b.{0,40}\b(access|requests?|connections?)\b",
        "low",
        0.6,
        "Text describes network access.",
        "Check the destinations the tool may contact.",
        (("network", "internet", "outbound"), ("access", "request", "connection")),
    ),
)

DEFAULT_RULES = PROMPT_INJECTION_RULES + CREDENTIAL_PERMISSION_RULES
DETECTORS = ("prompt_injection", "credential_reference", "permission_signal")


def enabled_rules(
    rules: tuple[Rule, ...] = DEFAULT_RULES,
    detectors: tuple[str, ...] = DETECTORS,
    min_confidence: float = 0.0,
) -> tuple[Rule, ...]:
    """Rules of the enabled detectors at or above a confidence."""
    if not 0.0 <= min_confidence <= 1.0:
        raise ValueError("min_confidence must be between 0 and 1.")
    unknown = set(detectors) - {r.detector for r in rules} - set(DETECTORS)
    if unknown:
        raise ValueError(f"unknown detectors: {sorted(unknown)}")
    return tuple(r for r in rules if r.detector in detectors and r.confidence >= min_confidence)
