"""Vocabularies of the data model: fixed values, and small tables made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Entity types.
ENTITY_TYPES = (
    "PERSON COMPANY GOVERNMENT ORGANIZATION LOCATION EVENT COUNTRY SECTOR COMMODITY PUBLIC_INSTITUTION STATE_OWNED_ENTERPRISE LAW_OR_POLICY"
    " MEDIA_OR_PUBLICATION TOPIC RISK OPPORTUNITY PROJECT COUNTRY_REGION CORPORATE_EVENT EDUCATIONAL_INSTITUTION EXCHANGE FACILITY LANGUAGE"
    " PRODUCT WORK_OF_ART ENTITY"
).split()
#: Types that act like organizations.
ORG_TYPES = "COMPANY GOVERNMENT ORGANIZATION PUBLIC_INSTITUTION STATE_OWNED_ENTERPRISE MEDIA_OR_PUBLICATION".split()
#: Relation types for new edges.
RELATION_TYPES = (
    "works_at leads is_ceo_of is_cfo_of is_cto_of is_coo_of is_cmo_of is_cso_of is_board_member_of is_member_of founded is_direct_parent_of"
    " is_ultimate_parent_of invested_in is_beneficial_owner_of is_controlled_person_of has_headquarters_in has_presence_in is_registered_in"
    " located_in within has_nationality native_to has_jurisdiction operates_in_industry spoke_at participates_in_corporate_event studied_at"
    " featured_in listed_on traded_on manufactured_by published_by created_by designed_by operated_by spoken_in represents supplier competitor"
    " acquirer critic advisor affiliated_with customer_of"
).split()
#: Relation types that old edges may still have.
OLD_RELATION_TYPES = "investor subsidiary regulator operates_in governs business_partner ally".split()
#: Roles of an entity in a source, the strongest first.
ROLES = (
    "interviewee interviewee_org primary_subject subject_organization author mention related_via_relationship participant interviewer translator"
    " account source_owner mentioned_at_source_level related_entity"
).split()
#: Labels of link types; others are their own words with capitals.
LINK_LABELS = {
    "interviewee": "Interviewee",
    "interviewee_org": "Organization",
    "participant": "Participant",
    "primary_subject": "Primary Subject",
    "author": "Author",
    "subject_organization": "Organization",
}
#: Origins that an editor or the upload gives, and the places of their link types in lists.
ANCHOR_ORIGINS = "upload_anchor metadata_import manual_tag human_review".split()
ANCHOR_PLACES = {"interviewee": 1, "interviewee_org": 2, "participant": 3}
#: Words before a name that are no part of it.
HONORIFICS = (
    "mr mrs ms miss dr prof professor sir madam dame lord lady minister director chairman chairwoman president ceo cfo coo cto general colonel"
    " captain major hon honorable honourable excellency ambassador senator governor sheikh imam mullah"
).split()
#: Words that tell no name apart.
STOP_WORDS = (
    "the of and for in to at by on with from a an is are was were be been has have had that this it its not but or as if we our"
).split()
#: Titles that may stand before a name that is not written out.
TITLE_BEFORE_NAME = r"\b(?:mr|mrs|ms|dr|prof|minister|governor|chairman|ambassador|ceo|president|director|secretary|commissioner|excellency)\.?\b"
#: Words after which a full stop ends no sentence.
ABBREVIATIONS = (
    "dr mr mrs ms prof gen col sgt rev inc corp ltd co jr sr st ft no vs vol dept est govt approx hon pres rep sen gov amb min sec fig ref etc al avg"
).split()
#: Relation type that a job title implies, tried in this order.
TITLE_RELATIONS = (
    ("is_ceo_of", r"\bceo\b|chief executive|managing director|presidente ejecutivo"),
    ("is_cfo_of", r"\bcfo\b|chief financial|finance director|director financiero"),
    ("is_cto_of", r"\bcto\b|chief technolog|technology director|director de tecnolog"),
    ("is_coo_of", r"\bcoo\b|chief operating|operations director|director de operaciones"),
    ("is_cmo_of", r"\bcmo\b|chief marketing|marketing director|director de marketing"),
    ("is_cso_of", r"\bcso\b|chief strategy|strategy director|director de estrategia"),
    ("is_board_member_of", r"\bboard\b|non.executive director|non exec|consejero"),
    ("founded", r"\bfounder\b|co-?founder\b|cofundador"),
    ("leads", r"\bminister\b|ministro|secretary of state|secretar[io]+ de estado|head of institution|director general|director.general"),
    ("is_member_of", r"\bdelegate\b|delegado"),
    ("advisor", r"\badvis[eo]r\b|adviser|consultant\b|consultor"),
    ("represents", r"\brepresent"),
)
#: Phrases by which a question means one source, and those by which it means a project.
ONE_SOURCE = (
    r"\bthis\s+interview\b|\bin\s+the\s+interview\b|\bfrom\s+this\s+interview\b|\bthis\s+transcript\b|\bin\s+this\s+conversation\b"
    r"|\bwhat\s+did\s+(he|she|they|the\s+interviewee)\s+say\b|\bwhat\s+was\s+said\s+about\b|\baccording\s+to\s+this\s+interview\b"
)
ONE_PROJECT = r"\bthis\s+project\b|\bacross\s+(all\s+)?interviews\b"
#: States of a source, and those in which work on it is under way.
STATUSES = "UPLOADING PROCESSING TRANSCRIBING EXTRACTING EMBEDDING COMPLETED FAILED".split()
IN_FLIGHT = "UPLOADING PROCESSING TRANSCRIBING EXTRACTING EMBEDDING".split()
#: Stages of a deal, in order.
STAGES = "lead qualified proposal negotiation closed_won closed_lost".split()


def words(spark: SparkSession, values: list[str] | tuple[str, ...], name: str = "value") -> DataFrame:
    """A vocabulary as a table with its order."""
    return spark.createDataFrame([(v, k) for k, v in enumerate(values)], f"{name} string, place int")
