"""Training-data operators: each module holds one operator with a general interface.

``queries`` registers the thin ``opN_<name>`` queries; nothing outside this subpackage imports it.
"""
