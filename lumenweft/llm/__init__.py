"""Training-data operators: ten corpus-scale building blocks and their registered queries.

Nothing outside this subpackage imports it; ``queries.py`` lists the
``opN_*`` queries and ``oracles.py`` the SQL for those that SQL can express.
"""
