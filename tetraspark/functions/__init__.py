"""Scalar functions on RDF terms, for use with the DataFrame API."""

from ..operators.terms import datatype, from_stored, kind, language, lexical, make_iri, make_literal, moment, number, to_stored

__all__ = ["datatype", "from_stored", "kind", "language", "lexical", "make_iri", "make_literal", "moment", "number", "to_stored"]
