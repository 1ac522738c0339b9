"""Operations of a training-data pipeline over documents, pages and conversations.

Each module holds one operator with its own general interface; ``catalog``
registers one query per operator.  Nothing else in the library imports this
package.
"""
