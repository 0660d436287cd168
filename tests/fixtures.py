"""Small tables by hand, in which every rule has cases that it finds and cases that it must leave alone."""

TYPOGRAPHY_CASES = [
    (0, "Deux  espaces ici et un , ici."),
    (1, "Des virgules,, doublées et rouge,vert collés"),
    (2, "La valeur 3,5 et f(a,bc) et x,y vont bien."),
    (3, "Voir C:\\dossier\\a,,b et www.site.fr,ici  encore"),
    (4, "Fin du mot . Puis;; encore"),
    (5, "Rien à signaler."),
]

#: (doc_id, ord, kind, text)
STRUCTURE_CASES = [
    (1, 0, "toc_entry", "Sommaire"), (1, 1, "toc_entry", "1 Introduction .... 3"), (1, 2, "toc_entry", "2 Résultats	7"), (1, 3, "toc_entry", "Annexe perdue ... 9"),
    (1, 4, "heading", "1 Introduction"), (1, 5, "paragraph", "Un e-mail est arrivé. Cet e-mail attend."), (1, 6, "heading", "1.1 Contexte"), (1, 7, "heading", "1.3 Méthode"),
    (1, 8, "paragraph", "Le réseau wi-fi et le réseau wifi. Un email suffit, le wifi aussi."), (1, 9, "heading", "2 Résultats"), (1, 10, "heading", "2.1 Mesures"), (1, 11, "heading", "4 Conclusion"),
    (2, 0, "paragraph", "Sans titre ni sommaire."), (2, 1, "heading", "3 Début"), (2, 2, "heading", "3.1 Suite"), (2, 3, "heading", "3.2 Suite"),
    (3, 0, "heading", "1. Seul"), (3, 1, "heading", "5. Saut"), (3, 2, "heading", "Sans numéro"), (3, 3, "heading", "5.2.1 Trop bas"), (3, 4, "heading", "5.2.2 Bien"), (3, 5, "heading", "6 Bien"), (3, 6, "heading", "6.2.4 Autre"),
]

LEXICON = [("maison", 5.2), ("maisons", 4.6), ("appeler", 4.5), ("professionnel", 4.4), ("élève", 4.7), ("élèves", 4.6), ("eleve", 1.0), ("bonjour", 5.0), ("chapeau", 3.9), ("château", 4.3), ("quand", 5.9), ("temps", 5.8), ("tente", 3.4), ("pente", 3.2), ("vente", 4.4), ("règle", 4.2), ("regle", 1.2), ("très", 6.1)]
TEXTS = ["La maisno est belle, l'apeller aussi. Un professionel dit bonjuor.", "Le chapo du chateau. Une eleve, la regle. Zzyzx et xvente", "C'est tres bien; bonjuor !"]

BLOCKS = [(1, 0, "paragraph", "Le chat chat dort."), (1, 1, "toc_entry", "Sommaire 3"), (2, 0, "paragraph", "Un mot ,  deux.")]
#: id, doc_id, ord, start, stop, expected_text, expected, replacement
EDITS = [
    (1, 1, 0, 3, 12, "Le chat chat dort.", "chat chat", "chat"), (2, 1, 0, 8, 17, "Le chat chat dort.", "chat dort", "rit"), (3, 1, 0, 13, 17, "Le chat chat dort.", "dort", "dort"),
    (4, 1, 1, 0, 8, "Sommaire 3", "Sommaire", "Table"), (5, 1, 7, 0, 1, "x", "x", "y"), (6, 2, 0, 3, 8, "Autre", "mot ,", "mot,"), (7, 2, 0, 3, 8, "Un mot ,  deux.", "mot ,", "mot,"),
    (8, 2, 0, 8, 10, "Un mot ,  deux.", "  ", " "), (9, 2, 0, 10, 99, "Un mot ,  deux.", "deux", "d"), (10, 2, 0, 0, 2, "Un mot ,  deux.", "Le", "Les"), (11, 2, 0, 10, 14, "Un mot ,  deux.", "deux", "deux\ttrois"), (12, 1, 0, 0, 2, "Le chat chat dort.", "Le", "Un"),
]
EDIT_SCHEMA = "id long, doc_id long, ord int, start int, stop int, expected_text string, expected string, replacement string"

GRAMMAR_TEXTS = [(1, 0, "Les serveur marchent et ils a mangé."), (1, 1, "Voir GitHub dans C:\\les\\serveur ici."), (2, 0, "Son satisfaisants restent les résultat. Ils a fini.")]
#: doc_id, ord, start, stop, rule, kind, suggestions
FINDINGS = [
    (1, 0, 4, 11, "gn_les_a1_1", "gn", ["serveurs"]), (1, 0, 28, 29, "conj_ils_b1_a1_1", "conj", ["ont"]), (1, 0, 24, 27, "conj_ils_b1_a2_1", "conj", ["il"]), (1, 0, 0, 3, "typo_a1_1", "typo", ["Le"]),
    (1, 1, 5, 11, "gn_x_a1_1", "gn", ["git"]), (1, 1, 17, 31, "gn_y_a1_1", "gn", ["les"]), (2, 0, 4, 17, "gn_z_a1_1", "gn", ["satisfaisant"]), (2, 0, 30, 38, "gn_w_a1_1", "gn", ["résultats"]), (2, 0, 40, 43, "inte_a1_1", "inte", []),
    (2, 0, 44, 45, "gn_v_a1_1", "gn", ["a ", "à"]), (2, 0, 46, 99, "gn_u_a1_1", "gn", ["x"]),
]
