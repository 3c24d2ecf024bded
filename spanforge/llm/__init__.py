"""Training-data operators: ten corpus-scale components and their registered queries.

Nothing outside this subpackage imports it; ``spanforge.llm.registry`` lists the queries.
"""
