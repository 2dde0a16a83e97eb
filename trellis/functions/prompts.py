"""Prompt templates of the five analysis levels and their fill rules.

The template texts below are fixed values that must equal the reference's
prompt file for identical prompts; they are stated verbatim, in the file's
order. ``load_prompt_table`` reads the same JSON layout from any path so a
deployment can supply its own file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- fixed values: prompt templates (level -> user prompt, system prompt) ----
PROMPTS = {
    'file': {
        "user": "{projectContext}\n\nUsing the provided project context, analyze this source file's business logic and implementation:\n\nKey points to address:\n- Core functionality and business purpose\n- Key interfaces/dependencies\n- Notable design patterns or architectural choices\n- Error handling approach\n- Any performance considerations\n\nFile content:\n{fileContent}",
        "system": "You are an expert at analyzing source code, with deep knowledge of programming langues and frameworks. Focus on:\n1. The business domain problem this code solves\n2. How it integrates with other components\n3. Important implementation details that impact maintainability or scalability\n4. Any dependencies on external libraries that could affect modernization\nProvide a concise 2-3 sentence response that captures these key aspects.",
    },
    'fileShort': {
        "user": "{projectContext}\n\nAnalyze this source file and provide a brief summary of its core business purpose and key technical aspects:\n\nFile content:\n{fileContent}",
        "system": "You are an expert at analyzing application source code. Provide a concise 2-3 sentence summary that captures: 1) The main business purpose of this code 2) Key technical implementation details. Be extremely concise.",
    },
    'package': {
        "user": "{projectContext}\n\nUsing the provided project context, synthesize a concise overview of source code package '{packageName}' in a narrative format. Your response should be a single paragraph long, focusing on the following aspects:\n\nDescribe the overall responsibility and purpose of the package within the larger module and project context. Highlight the core domain concepts implemented by the package and any significant architectural patterns employed at the package scope. Briefly mention any external systems or services that this package integrates with, and outline key design principles demonstrated across the package. If applicable, touch on how this package contributes to the module's broader capabilities or project goals.\n\nImportant: Provide a high-level conceptual summary rather than details about individual classes. Focus on creating a cohesive narrative that gives readers a clear understanding of the package's role, design approach, and significance within the larger system architecture.\n\nSupporting file analyses:\n{fileAnalyses}\n\n ## Instructions\n Begin your response with works 'This package'",
        "system": "You are an expert at analyzing source code and  application architecture. Your task is to:\n1. Synthesize the package's core business capability and domain concepts\n2. Identify key architectural and design patterns at the package level\n3. Describe how the package integrates with the broader system\n4. Note any framework dependencies affecting modernization\nImportant: Focus on package-level concepts rather than repeating individual class details. Provide a concise conceptual summary that emphasizes the package's unified purpose and role.",
    },
    'module': {
        "user": "{projectContext}\n\nUsing the provided project context, synthesize a high-level overview of source code module '{moduleName}' within project '{projectName}' in a narrative format. Your response should be approximately two paragraphs long for complex modules or a single paragraph for simpler modules consisting of only a few packages. Focus on the following aspects:\n\nParagraph 1: Describe the module's overall business domain purpose and its role within the larger project. Explain the key technical capabilities it provides and how these contribute to the project's goals. Highlight any strategic architectural decisions specific to this module.\n\nParagraph 2: Outline the module's integration strategy with other modules, including system boundaries and contracts. Discuss any significant design patterns or technical approaches used within the module. Conclude by mentioning any unique features or potential areas for future enhancement.\n\nImportant: Provide a high-level architectural summary rather than repeating package-level details. Focus on creating a flowing narrative that gives readers a clear understanding of the module's purpose, design, and capabilities within the context of the larger project.\n\nSupporting package analyses:\n{packageAnalyses}\n\n ## Instructions\n Begin your response with works 'This module'",
        "system": "You are an expert at analyzing application sourcecode, architecture and enterprise system modernization. For module '{moduleName}' in project '{projectName}', synthesize:\n1. The module's strategic role in the overall system\n2. Key architectural decisions that shape the module\n3. Critical technical capabilities provided\n4. Integration approach with other modules\n5. Any enterprise framework dependencies affecting modernization\nImportant: Focus on module-level architectural decisions rather than repeating package details. Provide a concise strategic summary that emphasizes the module's unified purpose and technical direction.\n\n ## Instructions\n Begin your response with works 'This module'",
    },
    'project': {
        "user": "{projectContext}\n\nUsing the provided project context, synthesize a comprehensive system-level overview of the project '{projectName}' in a narrative format. Your response should be approximately three paragraphs long for complex projects or a single paragraph for simpler projects consisting of only a few packages and source files. Focus on the following aspects:\n\nParagraph 1: Describe the overall business capabilities and value proposition of the project. Explain how it addresses key business needs and what sets it apart from similar solutions. Include any critical quality attributes that make this project particularly valuable.\n\nParagraph 2: Outline the system-wide architectural vision and key technical decisions. Discuss the primary design patterns employed, the rationale behind the chosen architecture, and how it supports the project's goals. Address any cross-cutting concerns and their solutions, as well as the external integration strategy.\n\nParagraph 3: Highlight the most significant technical features and capabilities of the project. Discuss how these features work together to create a cohesive system. Conclude by briefly mentioning any future directions or potential areas for enhancement.\n\nImportant: Provide a high-level architectural synthesis rather than repeating details already provided for module, package, or class descriptions. Instead, summarize these details at a strategic, system-level perspective to avoid redundancy.\n\nSupporting module analyses:\n{moduleAnalyses}\n\n ## Instructions\n Begin your response with works 'This project'",
        "system": "You are an expert at analyzing codebases for enterprise applications and modernization strategies. For project '{projectName}', synthesize:\n1. The system's core business value proposition\n2. Strategic architectural decisions and patterns\n3. Key technical capabilities and innovations\n4. Critical quality attributes and solutions\n5. Integration strategy and system boundaries\n6. Modernization opportunities and technical debt\nImportant: Focus on system-level architecture rather than repeating module details. Provide a strategic technical vision that emphasizes business value, architectural direction, and modernization potential.",
    },
}
# ---- end of fixed values ----

# Placeholder order of each level's fill; replacement is sequential, so text
# inserted early is itself subject to the later placeholders.
USER_FILL_ORDER = {
    "file": ["{fileContent}", "{projectContext}"],
    "fileShort": ["{fileContent}", "{projectContext}"],
    "package": ["{packageName}", "{fileAnalyses}", "{projectContext}"],
    "module": ["{moduleName}", "{projectName}", "{packageAnalyses}", "{projectContext}"],
    "project": ["{projectName}", "{moduleAnalyses}", "{projectContext}"],
}
SYSTEM_FILL_ORDER = {
    "file": [], "fileShort": [], "package": [],
    "module": ["{moduleName}", "{projectName}"],
    "project": ["{projectName}"],
}
CHILD_SEPARATOR = "\n\n"

PROMPT_SCHEMA = T.StructType([
    T.StructField("level", T.StringType(), False),
    T.StructField("user_prompt", T.StringType(), False),
    T.StructField("system_prompt", T.StringType(), False),
])


def prompt_rows(prompts: dict | None = None) -> list[tuple[str, str, str]]:
    p = prompts or PROMPTS
    return [(lvl, v["user"], v["system"]) for lvl, v in p.items()]


def load_prompt_table(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Five-row prompt table; from a JSON file of the reference layout when given."""
    if path is None:
        return spark.createDataFrame(prompt_rows(), PROMPT_SCHEMA)
    raw = spark.read.option("multiLine", True).json(path)
    levels = F.array(*[F.struct(F.lit(k).alias("level"), F.col(k)["userPrompt"].alias("user_prompt"),
                                F.col(k)["systemPrompt"].alias("system_prompt")) for k in PROMPTS])
    return raw.select(F.explode(levels).alias("p")).select("p.*")


def as_prompts(table: DataFrame) -> dict:
    """The five rows of a prompt table in the form of ``PROMPTS``, for the ``prompts`` argument of the builders."""
    return {r.level: {"user": r.user_prompt, "system": r.system_prompt} for r in table.collect()}
