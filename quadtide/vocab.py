"""IRIs and the few constants that data written for this model carries."""

# Namespaces and datatype IRIs that appear in the data itself.
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
XSD = "http://www.w3.org/2001/XMLSchema#"
PROV = "http://www.w3.org/ns/prov#"
SOSA = "http://www.w3.org/ns/sosa/"
UNC = "http://w3id.org/rsp/rspu#"

DEFAULT_GRAPH = "urn:default"


def iri(text: str) -> str:
    """Canonical term of an absolute IRI."""
    return f"<{text}>"


RDF_TYPE = iri(RDF + "type")
RDF_FIRST = iri(RDF + "first")
RDF_REST = iri(RDF + "rest")
RDF_NIL = iri(RDF + "nil")
RDF_STATEMENT = iri(RDF + "Statement")
RDF_SUBJECT = iri(RDF + "subject")
RDF_PREDICATE = iri(RDF + "predicate")
RDF_OBJECT = iri(RDF + "object")
GENERATED_AT = iri(PROV + "generatedAtTime")
HAS_RESULT = iri(SOSA + "hasSimpleResult")
MADE_BY = iri(SOSA + "madeBySensor")
FEATURE = iri(SOSA + "hasFeatureOfInterest")
UNCERTAINTY = iri(UNC + "uncertainty")
DISTRIBUTION = UNC + "distribution"
LANG_STRING = RDF + "langString"
