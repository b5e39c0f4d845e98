"""Explicit schemas of the engine's tables; no reader infers one. Vectors have no fixed width."""

from __future__ import annotations

from pyspark.sql import types as T


DDL: dict[str, str] = {}


def __getattr__(name: str) -> T.StructType:
    """schemas.NAME: the schema of that name (Spark parses it, so a session must be there)."""
    if name in DDL:
        return T.StructType.fromDDL(DDL[name])
    raise AttributeError(name)


DDL["COURT_DECISION"] = ("doc_id string, case_no string, attr_yr string, tax_type string, decision string, title string, has_full_text boolean, document string, embedding array<float>")
DDL["TRIBUNAL_RULING"] = ("dem_no string, case_no string, decision_date string, tax_type string, decision string, related_laws string, title string, document string, embedding array<float>")
DDL["STATUTE_ARTICLE"] = ("law_name string, slug string, scope string, article_id string, article_no string, title string, domain string, version_key string, effective_date date, abolition_date date, document string, embedding array<float>")
DDL["REPLY"] = ("doc_id string, doc_no string, tax_type string, reply_date string, title string, category string, document string, embedding array<float>")
DDL["LAW_VERSION"] = ("law_family string, scope string, version_key string, pdate date, pno string, pno_norm string, eff_date date, law_name string, mst string, file string")
DDL["VERSION_ENTRY"] = ("version_key string, pdate string, pno string, eff_date string, law_name string, mst string, file string")
DDL["SENTENCE"] = ("case_id string, pid int, sid string, text string, type2 string, role string, speaker string, is_argument boolean, is_court_reasoning boolean, is_reasoning_core boolean, is_legal_basis boolean, is_fact boolean")
DDL["CITATION"] = ("source_type string, title string, citation_text string, promulgation_no string, promulgation_type string, is_prior_version boolean, effective_before string")
DDL["ISSUE_CHAIN"] = ("case_id string, uid string, issue string, premise string, evidence string, rule string, application string, inference string, mini_conclusion string, citations array<struct<source_type:string,title:string,citation_text:string,promulgation_no:string,promulgation_type:string,is_prior_version:boolean,effective_before:string>>")
DDL["STAGE"] = ("case_id string, stage string, body string, updated_at timestamp")
DDL["ARTICLE_UNIT"] = ("version_key string, article_id string, level string, para_no string, item_no string, subitem_no string, text string")
DDL["LAW_DOCUMENT"] = (
    "law_id string, law_name string, chapters array<struct<id:string,name:string,domain:string,"
    "articles:array<struct<id:string,title:string,domain:string,raw_text:string,paragraphs:array<struct<para_no:string,text:string,items:array<struct<item_no:string,text:string,subitems:array<struct<subitem_no:string,text:string>>>>>>>>,"
    "sections:array<struct<id:string,name:string,domain:string,articles:array<struct<id:string,title:string,domain:string,raw_text:string,paragraphs:array<struct<para_no:string,text:string,items:array<struct<item_no:string,text:string,subitems:array<struct<subitem_no:string,text:string>>>>>>>>>>>>")
DDL["EDGE"] = ("edge_type string, src_type string, src_id string, dst_type string, dst_id string, props map<string,string>")
