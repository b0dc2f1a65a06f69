"""Prompts for the language model, as columns, in this engine's own words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds of entities that are looked for by default (fixed values).
ENTITY_TYPES = ("Person", "Creature", "Organization", "Location", "Event", "Concept", "Method", "Content", "Data", "Artifact", "NaturalObject")


def extraction(text: Column, types: tuple[str, ...] = ENTITY_TYPES, most_entities: int = 45, most_relations: int = 60) -> Column:
    """Ask for entity and relation lines in the form that ``operators.extract`` reads."""
    head = (
        f"List at most {most_entities} entities and at most {most_relations} relations of the text below, one to a line.\n"
        f"Entity line: entity<|#|>name<|#|>kind<|#|>description, with one of the kinds {', '.join(types)}.\n"
        "Relation line: relation<|#|>source<|#|>target<|#|>keywords<|#|>description<|#|>weight.\nEnd with <|COMPLETE|>.\n\nText:\n"
    )
    return F.concat(F.lit(head), text)


def keywords(question: Column) -> Column:
    head = 'Give the themes and the concrete terms of this question as JSON {"high_level_keywords": [...], "low_level_keywords": [...]}.\n\nQuestion: '
    return F.concat(F.lit(head), question)


def summary(name: Column, parts: Column, words: int = 600) -> Column:
    """Descriptions go in as lines of JSON."""
    lines = F.array_join(F.transform(parts, lambda p: F.to_json(F.struct(p.alias("description")))), "\n")
    return F.concat(F.lit("Unite the descriptions of "), name, F.lit(f" in at most {words} words. Keep every fact.\n\n"), lines)


def answer(context: Column, question: Column, response_type: str) -> Column:
    return F.concat(F.lit(f"Answer from the context only and cite the files it names. Form of the answer: {response_type}.\n\n"), context, F.lit("\n\nQuestion: "), question)
