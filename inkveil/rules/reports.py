"""Texts of the analysis reports: fixed answers, defaults and prompt templates."""

from __future__ import annotations

from dataclasses import dataclass

# What the text extraction returns for a blank file.
NO_TEXT = "No text content found."

# Report of a blank file.
BLANK_SUMMARY = "A file that is blank or contains no discernible text content."
BLANK_FINDING = (
    "The submitted file lacks content, indicating a potential data integrity issue or a "
    "process gap in evidence collection."
)

# Fields a response left out.
MISSING_SUMMARY = "Analysis completed but summary not provided"
MISSING_FINDING = "Analysis completed but no specific findings provided"

# A response without JSON, and one with broken JSON.
UNSTRUCTURED_SUMMARY = "Analysis of "
UNSTRUCTURED_EMPTY = "No analysis available"
UNSTRUCTURED_FINDING = "AI provided unstructured analysis - manual review recommended"
BROKEN_SUMMARY = "Analysis completed but JSON parsing failed"
BROKEN_FINDING = "Raw analysis available but not in expected format: "
BROKEN_CAUSE = "invalid JSON"

# Error texts of failed calls.
KEY_ERROR = "API Key issue - please verify your credentials"
EMPTY_RESPONSE = "Empty response from API"

# Defaults of the consolidated report.
NOT_AVAILABLE = "N/A"
NO_SUMMARY = "No summary provided."
NO_FINDINGS = "No findings reported."

# The line above the rows of a sheet.
SHEET_HEADING = "--- Sheet: %s ---"

# The sentence above the compiled reports.
HEADLINE = "This report summarizes the automated analysis of %d processed files."

# What a failed analysis says, and an unstructured one of its length.
ALL_RETRIES_FAILED = ("Analysis for ", " failed after all retries")
ANALYSIS_FAILED = "Analysis failed: "
RAW_LENGTH = ("Raw response length: ", " characters")

# How many characters are kept of what.
PROMPT_CHARACTERS = 15000
SUMMARY_CHARACTERS = 300
RAW_ANALYSIS_CHARACTERS = 2000
RAW_RESPONSE_CHARACTERS = 1000

# The typed fields of a report, in order, with their Spark types.
REPORT_FIELDS: dict[str, str] = {
    "document_summary": "string",
    "key_security_findings": "array<string>",
    "environment_type": "string",
    "people_count": "string",
    "redacted_content_noted": "boolean",
    "security_controls_observed": "array<string>",
    "potential_vulnerabilities": "array<string>",
    "document_type_classification": "string",
    "sensitivity_assessment": "string",
    "compliance_frameworks_referenced": "array<string>",
    "security_domains_covered": "array<string>",
    "priority_recommendations": "array<string>",
    "source_file_name": "string",
    "source_file_type": "string",
    "model_used": "string",
    "analysis_timestamp": "string",
    "raw_analysis": "string",
    "raw_response": "string",
    "error": "string",
    # Everything else the model returned, as JSON text.
    "other_fields": "string",
}


@dataclass(frozen=True)
class PromptTemplates:
    """Templates with the places {file_name}, {file_type} and {text}.

    The wording is free; the JSON fields asked for have to be those of
    ``REPORT_FIELDS``.
    """

    text: str = (
        "Review the security aspects of the document '{file_name}' ({file_type}).\n\n"
        "---\n{text}\n---\n\n"
        "Say what kind of document it is and how sensitive, what it shows about controls, "
        "policies and data protection, where it reveals weaknesses, and what should be done "
        "first. Stay with what this document says.\n\n"
        "Answer with one JSON object: document_summary (string), key_security_findings (list "
        "of strings), document_type_classification (policy/procedure/technical/audit/"
        "compliance/other), sensitivity_assessment (public/internal/confidential/restricted), "
        "compliance_frameworks_referenced, security_domains_covered and "
        "priority_recommendations (lists of strings)."
    )
    image: str = (
        "Review the security aspects of the image '{file_name}'.\n\n"
        "Describe the scene, the people and what they do, the physical and information "
        "security visible, and the weaknesses. Black areas are intended redactions; say what "
        "they seem to protect. Stay with what can be seen.\n\n"
        "Answer with one JSON object: document_summary (string), key_security_findings (list "
        "of strings), environment_type (office/industrial/retail/public/residential/other), "
        "people_count (number), redacted_content_noted (true/false), "
        "security_controls_observed and potential_vulnerabilities (lists of strings)."
    )
