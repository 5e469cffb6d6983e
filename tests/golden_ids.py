"""The sites of one sample's calls and the identifiers that they must get, before and after splitting."""

# Position, reference allele, alternate alleles on contig 20.
SITES = """
10009875 A G,AGGGAGG
10009879 A G
10009883 A G
10010393 T G
10010536 G GA
10010766 T G
10011309 T C
10011517 GA G
10011666 C T
10011939 C T
10012021 CA C
10012518 T C
10012521 C T
10012570 G GCA
10012572 GT G
10012631 C CG
10012636 G C
10012714 G C
10012751 T C
10013119 C T
10013574 G A
10014990 C CAT
10015679 C T
10015761 T C
10024107 C T
10024300 C CTT
10026357 T C
10026794 C T
10027234 A ATTAG
10027868 A G
10027872 A G
10028867 A ATG
10030188 T A
10031254 A AT
10031342 G A
10031798 G A
10032882 A T
10032972 C CAT
10034306 T C
10036930 CGATAGCCCTAGCCCTAGATA C
10037037 C T
10037110 T TGATA
10037144 T TGATAGATA
10037709 A T
10039371 T G
10040772 C CT
10040812 AT A
10040821 T A
10041304 C T
10041701 A ATATG
"""

# The identifiers of whole sites.
WHOLE = """
20:10009874:A:G,AGGGAGG
20:10009878:A:G
20:10009882:A:G
20:10010392:T:G
20:10010535:G:GA
20:10010765:T:G
20:10011308:T:C
20:10011516:GA:G
20:10011665:C:T
20:10011938:C:T
20:10012020:CA:C
20:10012517:T:C
20:10012520:C:T
20:10012569:G:GCA
20:10012571:GT:G
20:10012630:C:CG
20:10012635:G:C
20:10012713:G:C
20:10012750:T:C
20:10013118:C:T
20:10013573:G:A
20:10014989:C:CAT
20:10015678:C:T
20:10015760:T:C
20:10024106:C:T
20:10024299:C:CTT
20:10026356:T:C
20:10026793:C:T
20:10027233:A:ATTAG
20:10027867:A:G
20:10027871:A:G
20:10028866:A:ATG
20:10030187:T:A
20:10031253:A:AT
20:10031341:G:A
20:10031797:G:A
20:10032881:A:T
20:10032971:C:CAT
20:10034305:T:C
20:10036929:CGATAGCCCTAGCCCTAGATA:C
20:10037036:C:T
20:10037109:T:TGATA
20:10037143:T:TGATAGATA
20:10037708:A:T
20:10039370:T:G
20:10040771:C:CT
20:10040811:AT:A
20:10040820:T:A
20:10041303:C:T
20:10041700:A:ATATG
"""

# The identifiers after splitting.
SPLIT = """
20:10009874:A:G
20:10009874:A:AGGGAGG
20:10009878:A:G
20:10009882:A:G
20:10010392:T:G
20:10010535:G:GA
20:10010765:T:G
20:10011308:T:C
20:10011516:GA:G
20:10011665:C:T
20:10011938:C:T
20:10012020:CA:C
20:10012517:T:C
20:10012520:C:T
20:10012569:G:GCA
20:10012571:GT:G
20:10012630:C:CG
20:10012635:G:C
20:10012713:G:C
20:10012750:T:C
20:10013118:C:T
20:10013573:G:A
20:10014989:C:CAT
20:10015678:C:T
20:10015760:T:C
20:10024106:C:T
20:10024299:C:CTT
20:10026356:T:C
20:10026793:C:T
20:10027233:A:ATTAG
20:10027867:A:G
20:10027871:A:G
20:10028866:A:ATG
20:10030187:T:A
20:10031253:A:AT
20:10031341:G:A
20:10031797:G:A
20:10032881:A:T
20:10032971:C:CAT
20:10034305:T:C
20:10036929:CGATAGCCCTAGCCCTAGATA:C
20:10037036:C:T
20:10037109:T:TGATA
20:10037143:T:TGATAGATA
20:10037708:A:T
20:10039370:T:G
20:10040771:C:CT
20:10040811:AT:A
20:10040820:T:A
20:10041303:C:T
20:10041700:A:ATATG
"""
