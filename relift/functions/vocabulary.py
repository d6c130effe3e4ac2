"""IRIs of the vocabularies (fixed values of the W3C and RML specifications)."""

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDF_TYPE = RDF + "type"
LANG_STRING = RDF + "langString"
XSD = "http://www.w3.org/2001/XMLSchema#"
XSD_STRING = XSD + "string"

RR = "http://www.w3.org/ns/r2rml#"
RML = "http://w3id.org/rml/"
RML_OLD = "http://semweb.mmlab.be/ns/rml#"
#: Namespaces that a mapping's terms may have, newest first.
NAMESPACES = (RML, RR, RML_OLD)
D2RQ = "http://www.wiwiss.fu-berlin.de/suhl/bizer/D2RQ/0.1#"

#: Where blank nodes live once they are IRIs.
BNODE = "urn:bnode:"
