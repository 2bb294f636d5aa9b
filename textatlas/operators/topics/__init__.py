"""Topic models: document-term tables, LDA, embedding clusters, topic terms, labels, coherence, agreement."""
